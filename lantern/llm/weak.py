"""Weak supervision: a generative model of voters, and a hashed linear scorer trained on its posterior labels."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np


def hashed(feature: str, dim: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % dim


@dataclass
class LabelModel:
    """The share of each class; for each voter and class the chances of its votes (-1 for none, 0, 1); the voters'
    correlations within the classes, and the weight that these leave each."""

    prior: np.ndarray
    chances: np.ndarray  # voter, class, vote + 1
    weights: np.ndarray
    correlations: np.ndarray
    silence: bool

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of each class for each row of votes."""
        logs = np.log(self.chances)
        if not self.silence:
            logs[:, :, 0] = 0
        at = np.arange(votes.shape[1])
        x = np.log(self.prior) + np.einsum("nmk,m->nk", logs[at, :, votes + 1], self.weights)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def accuracies(self, votes: np.ndarray, counts: np.ndarray, good: int) -> np.ndarray:
        """The expected share of each voter's votes that are right: 1 for class good, 0 for any other."""
        p = self.posterior(votes)[:, good]
        right = (((votes == 1) * p[:, None] + (votes == 0) * (1 - p)[:, None]) * counts[:, None]).sum(0)
        return right / np.maximum(((votes >= 0) * counts[:, None]).sum(0), 1e-12)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, first: np.ndarray, silence: bool, rounds: int = 50, smoothing: float = 1.0) -> LabelModel:
    """Expectation maximisation over the distinct patterns of votes and how often each occurs.

    first: the chances of the classes to begin with. silence: whether it tells something if a voter doesn't vote. After
    each estimate of the voters' chances, what is left of their agreement within the classes gives their correlations,
    and a voter that others repeat counts so much less.
    """
    m, classes = votes.shape[1], first.shape[1]
    counts, p = counts.astype(float), first.astype(float)
    for _ in range(rounds):
        shares = counts[:, None] * p
        prior = (shares.sum(0) + 1e-3) / (shares.sum() + 1e-3 * classes)
        chances = np.stack([(votes == v).T.astype(float) @ shares for v in (-1, 0, 1)], axis=2) + smoothing / 100
        if not silence:
            chances[:, :, 0] = 0
        chances /= chances.sum(2, keepdims=True)
        mean = chances[:, :, 2] - chances[:, :, 0]
        covariance = np.zeros((m, m))
        for k in range(classes):
            x = votes - mean[:, k] if silence else np.where(votes < 0, 0, votes - chances[:, k, 2])
            covariance += (x * shares[:, k, None]).T @ x
        scale = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        correlations = covariance / np.outer(scale, scale)
        np.fill_diagonal(correlations, 1)
        weights = 1 / np.maximum((np.maximum(correlations, 0) ** 2).sum(1), 1)
        model = LabelModel(prior, np.maximum(chances, 1e-12), weights, correlations, silence)
        new = model.posterior(votes)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


@dataclass
class Linear:
    """Weights by hashed feature, and the bias."""

    weights: dict[int, float]
    bias: float

    def score(self, indices, values=None) -> float:
        w = self.weights
        x = self.bias + (sum(w.get(i, 0.0) for i in indices) if values is None else sum(w.get(i, 0.0) * v for i, v in zip(indices, values, strict=True)))
        return float(1 / (1 + np.exp(-min(max(x, -500), 500))))


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, ridge: float = 1e-4, rounds: int = 400, rate: float = 0.1) -> Linear:
    """Logistic regression on soft labels. rows, columns and values are the entries of a sparse matrix."""
    n = max(len(target), 1)
    used, at = np.unique(columns, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    m, s, mb, sb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        x = bias + np.bincount(rows, values * w[at], minlength=len(target)) if len(rows) else np.full(len(target), bias)
        r = (1 / (1 + np.exp(-np.clip(x, -50, 50))) - target) / n
        g = (np.bincount(at, values * r[rows], minlength=len(used)) if len(rows) else np.zeros(0)) + ridge * w
        gb = float(r.sum())
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / a) / (np.sqrt(s / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(sb / b) + 1e-8)
    return Linear(dict(zip(used.tolist(), w.tolist(), strict=True)), bias)
