"""Label models, classifiers and scores of toxicity and quality against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest

from lantern.llm import quality, toxicity
from lantern.llm.common import table
from lantern.llm.weak import fit_label_model, fit_linear, hashed

SF = "/root/testdata/sf0.001"


def plain_label_model(rows, counts, first, silence, rounds=50):
    """Expectation maximisation, voter by voter and row by row."""
    n, m, classes, p = len(rows), len(rows[0]), len(first[0]), [list(map(float, f)) for f in first]
    for _ in range(rounds):
        share = [[counts[i] * p[i][k] for k in range(classes)] for i in range(n)]
        total = sum(map(sum, share))
        prior = [(sum(s[k] for s in share) + 1e-3) / (total + 1e-3 * classes) for k in range(classes)]
        chance = {}
        for j in range(m):
            for k in range(classes):
                c = [sum(share[i][k] for i in range(n) if rows[i][j] == v) + 0.01 for v in (-1, 0, 1)]
                c = c if silence else [0.0, *c[1:]]
                chance[j, k] = [x / sum(c) for x in c]
        cov = [[0.0] * m for _ in range(m)]
        for i in range(n):
            for k in range(classes):
                x = [rows[i][j] - (chance[j, k][2] - chance[j, k][0]) if silence else 0 if rows[i][j] < 0 else rows[i][j] - chance[j, k][2] for j in range(m)]
                for a in range(m):
                    for b in range(m):
                        cov[a][b] += share[i][k] * x[a] * x[b]
        scale = [math.sqrt(max(cov[j][j], 1e-9)) for j in range(m)]
        weight = [1 / max(sum((1.0 if a == b else max(cov[a][b] / scale[a] / scale[b], 0)) ** 2 for b in range(m)), 1) for a in range(m)]
        new = []
        for row in rows:
            x = [math.log(prior[k]) + sum(weight[j] * math.log(max(chance[j, k][row[j] + 1], 1e-12)) for j in range(m) if silence or row[j] >= 0) for k in range(classes)]
            e = [math.exp(y - max(x)) for y in x]
            new.append([y / sum(e) for y in e])
        moved = max(abs(a - b) for u, v in zip(p, new) for a, b in zip(u, v))
        if moved < 1e-6:
            break
        p = new
    return new


@pytest.mark.parametrize("silence", [True, False])
def test_label_model(silence):
    draw = np.random.default_rng(2)
    truth = draw.random(300) < 0.3
    votes = np.array([[(-1 if draw.random() < 0.2 else int(t) if draw.random() < acc else 1 - int(t)) for acc in (0.9, 0.8, 0.7, 0.6)] for t in truth])
    votes = np.column_stack([votes, votes[:, 0]])  # a voter that repeats another
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    counts = np.bincount(at.ravel())
    share = (patterns == 1).mean(axis=1)
    first = np.column_stack([1 - 0.9 * share - 0.05, 0.9 * share + 0.05])
    model = fit_label_model(patterns, counts, first, silence)
    assert np.allclose(model.posterior(patterns), plain_label_model(patterns.tolist(), counts.tolist(), first.tolist(), silence), atol=1e-4)
    assert model.weights[0] < model.weights[2] and model.correlations[0, 4] > 0.99


def test_linear_model_is_at_the_least_loss():
    draw = np.random.default_rng(4)
    x = draw.random((200, 5)) * (draw.random((200, 5)) < 0.5)
    target = 1 / (1 + np.exp(-(x @ [3, -2, 1, 0, 0.5] - 0.5)))
    rows, columns = np.nonzero(x)
    model = fit_linear(rows, columns, x[rows, columns], target, rounds=4000, rate=0.02)
    score = np.array([model.score(np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in x])
    w = np.array([model.weights[k] for k in range(5)])
    assert np.abs(x.T @ (score - target) / 200 + 1e-4 * w).max() < 1e-3 and np.abs(score - target).max() < 0.02


def test_toxicity_scores(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        words = toxicity.words_of(r["text"])
        names = set(words) | {toxicity.size_of(words)}
        beginnings = Counter(w[:n] + "-" for w in words for n in toxicity.BEGINNINGS if len(w) > n)
        names |= set(beginnings) | {f"{b}{k}" for b, n in beginnings.items() for k in (2, 3) if n >= k}
        x = model.bias + sum(model.weights.get(i, 0.0) for i in {hashed(f, toxicity.DIM) for f in names})
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-x))) < 1e-9


def test_quality_scores(spark):
    docs = table(spark, SF, "documents")
    model = quality.fit(docs)
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs).collect()}
    for r in docs.collect():
        words = (r["text"] or "").split()
        n, shapes = max(len(words), 1), Counter(quality.shape(w)[0] for w in words)
        x = model.bias + sum(5 * c / n * model.weights.get(hashed(s, quality.DIM), 0.0) for s, c in shapes.items())
        x += 5 * sum(a == b for a, b in zip(words, words[1:])) / n * model.weights.get(hashed("repeats", quality.DIM), 0.0)
        variety = sum(len(set(words[at : at + 200])) for at in range(0, len(words), 200)) / n if words else 1.0
        x += 5 * (1 - variety) * model.weights.get(hashed("same", quality.DIM), 0.0)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-x))) < 1e-6
