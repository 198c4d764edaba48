"""Similarity of names. Edit distance is Spark's own; Jaro-Winkler is computed on arrays, a batch of pairs at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a run of pairs, side by side, that the arrays may hold.
MOST_LETTERS = 1 << 21


def _letters(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each text, filled up with zeros, and the lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    wide = np.array(texts, dtype=f"U{max(1, size.max(initial=1))}")
    return wide.view(np.uint32).reshape(len(texts), -1), size


def jaro_winkler_of(a: np.ndarray, b: np.ndarray, p: float = 0.1) -> np.ndarray:
    """The similarity of the texts of two arrays, pair by pair, with the prefix bonus at any similarity and halved
    transpositions kept as fractions."""
    n = len(a)
    if not n:
        return np.zeros(0)
    x, size_x = _letters(a)
    y, size_y = _letters(b)
    reach, at = np.maximum(size_x, size_y) // 2 - 1, np.arange(y.shape[1])
    free, hit = at < size_y[:, None], np.zeros(x.shape, bool)
    for i in range(x.shape[1]):  # each letter takes the first free equal one within reach
        fits = free & (y == x[:, i : i + 1]) & (np.abs(at - i) <= reach[:, None]) & (i < size_x)[:, None]
        first, hit[:, i] = fits.argmax(axis=1), fits.any(axis=1)
        rows = np.flatnonzero(hit[:, i])
        free[rows, first[rows]] = False
    taken = ~free & (at < size_y[:, None])
    same = hit.sum(axis=1)
    k = min(x.shape[1], y.shape[1])
    mine = np.take_along_axis(x, np.argsort(~hit, axis=1, kind="stable"), axis=1)[:, :k]
    theirs = np.take_along_axis(y, np.argsort(~taken, axis=1, kind="stable"), axis=1)[:, :k]
    swapped = ((mine != theirs) & (np.arange(k) < same[:, None])).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (same / size_x + same / size_y + (same - swapped / 2) / same) / 3
    head = min(4, k)
    equal = (x[:, :head] == y[:, :head]) & (np.arange(head) < np.minimum(size_x, size_y)[:, None])
    prefix = np.cumprod(equal, axis=1).sum(axis=1)
    out = np.where(same > 0, jaro + prefix * p * (1 - jaro), 0.0)
    return np.where(np.asarray(a, object) == np.asarray(b, object), 1.0, out)


def jaro_winkler(a: Column, b: Column) -> Column:
    """0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = x.to_numpy(object), y.to_numpy(object)
        width = np.fromiter((max(len(s), len(t), 1) for s, t in zip(left, right, strict=True)), np.int64, len(left))
        out, order, begin = np.zeros(len(left)), np.argsort(width, kind="stable"), 0
        while begin < len(order):  # pairs of about the same length go together, as many as the arrays may hold
            end = begin + max(1, int(MOST_LETTERS // width[order[begin]]))
            while end > begin + 1 and width[order[min(end, len(order)) - 1]] * (min(end, len(order)) - begin) > 2 * MOST_LETTERS:
                end = begin + (end - begin + 1) // 2
            run = order[begin:end]
            out[run] = jaro_winkler_of(left[run], right[run])
            begin = end
        return pd.Series(out)

    return each(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def _tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, r"\s+"), lambda t: t != ""))


def token_set(a: Column, b: Column) -> Column:
    """The best of the sorted common tokens, these with the rest of a, and with the rest of b, against each other."""
    x, y = _tokens(a), _tokens(b)
    common = F.array_join(F.array_sort(F.array_intersect(x, y)), " ")
    left, right = F.array_join(F.array_sort(x), " "), F.array_join(F.array_sort(y), " ")
    found = F.greatest(jaro_winkler(common, left), jaro_winkler(common, right), jaro_winkler(left, right))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(found)


def best_similarity(a: Column, b: Column) -> Column:
    best = F.greatest(levenshtein_similarity(a, b), jaro_winkler(a, b), token_set(a, b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(best)
