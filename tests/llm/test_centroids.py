"""Clusters around integer centroids against a plain version, and the annulus on its own."""

import hashlib
import math

import numpy as np
import pytest

from lantern.llm import centroids

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16, rounds=3, size=64, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))
    middles = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(middles))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        middles = [[sum(x) // len(mine[n]) for x in zip(*mine[n])] if n in mine else c for n, c in enumerate(middles)]
    found = [(i, near(v)) for i, v in kept]
    inertia = {}
    for _, (d, n) in found:
        inertia[n] = inertia.get(n, 0) + d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), ",".join(map(str, middles[n]))) for i, (d, n) in found), key=str)


def got(spark, rows, **more):
    return sorted((tuple(r) for r in centroids.clustered(spark.createDataFrame([(*r, 1) for r in rows], KIND), **more).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_plain_version(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [(int(i), (draw.normal(size=6) * draw.choice([0.1, 1, 5])).tolist()) for i in draw.integers(0, 60, 90)]
    rows += [(None, [1.0] * 6), (7, None), (8, [1.0] * 5), (9, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (10, [math.nan] * 6), (11, [math.inf] * 6), (12, [0.0] * 6), (12, [0.0] * 6), (13, [3e5] * 6), (14, [-3e6] * 6)]
    assert got(spark, rows, k=8, size=6) == plain(rows, k=8, size=6)


def test_ties_few_and_no_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(12)]  # equal seeds: the smaller number takes all
    assert got(spark, rows, k=5, size=2) == plain(rows, k=5, size=2)
    assert got(spark, rows[:2], size=2) == plain(rows[:2], size=2)
    assert got(spark, [(1, None)]) == []


def test_very_large_components(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 2.0])]
    found = got(spark, rows, k=1, size=2)
    assert len(found) == 3 and max(r[2] for r in found) == (1 << 63) - 1


def test_annulus_finds_the_nearest():
    draw = np.random.default_rng(5)
    middles, vectors = draw.integers(-90, 90, (40, 3)), draw.integers(-90, 90, (3000, 3))
    far = ((vectors[:, None, :] - middles[None]) ** 2).sum(axis=2)
    number, best = centroids.Annulus(middles.tolist()).nearest(vectors)
    assert (number == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
