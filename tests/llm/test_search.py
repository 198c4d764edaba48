import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import ann

KIND = "vec_id long, embedding array<double>"


def exact(v, q, k):
    s = v @ v[q]
    s[q] = -np.inf
    return np.lexsort((np.arange(len(v)), -s))[: min(k, len(v) - 1)].tolist()


@pytest.mark.parametrize("n", [1, 2, 15, 21, 40])
def test_few_candidates_are_found_all(spark, n):
    v = np.random.default_rng(n).normal(size=(n, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], KIND).withColumns({"rank": F.lit(9), "v": F.lit("x"), "part": F.lit(1)})
    found = ann.search(df, df, k=20).collect()
    for q in range(n):
        mine = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert len(mine) == min(20, n - 1)
        if n <= 21:
            assert mine == exact(v, q, 20)


def test_an_outlier_beside_a_hot_cluster(spark):
    rng = np.random.default_rng(2)
    v = np.vstack([np.tile(rng.normal(size=16), (300, 1)), -rng.normal(size=(1, 16)) * 3])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], KIND)
    found = ann.search(df, df.where("vec_id >= 298"), k=20, block=64).collect()
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 300) == list(range(20))
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 299] == list(range(20))


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0]), (5, None), (6, [float("inf"), 1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (2, [0.0, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, KIND)
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.search(df, df).collect()}
    assert found == {(1, 2): 0.0, (2, 1): 0.0}  # of id 2 the smaller vector
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_probes_are_all_buckets_within_the_distance():
    rng = np.random.default_rng(3)
    for axes in (1, 2, 3):
        d = np.abs(rng.normal(size=(axes, 8)))
        d -= d.min(axis=1, keepdims=True)
        group, some = ann.probed(d, 0.9)
        got = {(int(g), int(a)) for g, row in zip(group, some, strict=True) for a in np.flatnonzero(row)}
        every = np.ndindex(*[8] * axes)
        assert got == {(sum(a * 8 ** (axes - 2 - i) for i, a in enumerate(c[:-1])), c[-1]) for c in every if sum(d[i, a] for i, a in enumerate(c)) <= 0.9}


def test_float_unit_vectors_get_no_component():
    x = np.random.default_rng(0).normal(size=(500, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    assert ann.lifted(x, (x * x).sum(1).max(), 64).shape == (500, 64) and np.allclose(ann.lifted(x, (x * x).sum(1).max(), 64), x)
    assert ann.axes_for(2000, 64) == 2 and ann.axes_for(10**7, 64) == 3 and ann.axes_for(10**9, 64) == 4


def test_single_precision_is_scored_in_double(spark):
    v = np.random.default_rng(8).normal(size=(60, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=5).collect():
        assert r["score"] == pytest.approx(v[r["vec_id"]].astype(float) @ v[r["query_id"]].astype(float), abs=1e-14)


@pytest.mark.parametrize("route", [1, 2, 3])
def test_a_group_of_any_number_of_axes_reaches_all_buckets_within_the_distance(route):
    rng, axes, within = np.random.default_rng(4), 3, 1.1
    x, y = rng.normal(size=(5, 4)), rng.normal(size=(200, 4))
    d, code = ann.distances(x, 2, axes), ann.codes(y, 2, axes)
    want = sum(d[:, k][:, code[:, k]] for k in range(axes)) <= within
    part, rest = code[:, :route] @ 8 ** np.arange(route - 1, -1, -1), code[:, route:] @ 8 ** np.arange(axes - route - 1, -1, -1)
    for q in range(len(x)):
        groups = ann.routed(d[q], within, route)
        assert {*part[want[q]]} <= {*groups.tolist()} and len({*groups.tolist()}) == len(groups)
    for g in {*part.tolist()}:
        assert (ann.reached(x, 2, g, rest[part == g], route, axes, within) == want[:, part == g]).all()


def test_probes_are_sent_in_small_batches(spark, monkeypatch):
    """A batch of queries goes to many times as many groups; no Arrow batch holds all of them."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    v = np.random.default_rng(6).normal(size=(300, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").coalesce(1)
    far = 1e9  # all of them
    seen = []
    run = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: seen.append(f) or run(self, f, schema))
    rows = ann.probes(df, 16, 2, 2, 1, far)
    batches = list(seen[0](iter(df.toArrow().to_batches())))
    assert rows.count() == 300 * 2 * 32 == sum(b.num_rows for b in batches)
    assert max(b.num_rows for b in batches) < 64 + 32


def test_few_axes_where_neighbours_are_far_and_more_where_they_are_near():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(16, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = rng.normal(size=(16, 16))
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    n = 10**6
    assert ann.axes_for(n, 16) > 2
    assert ann.tuned(x, x, x, n, 4, 0.95)[:2] == (3, 2)
    axes, route, within = ann.tuned(x, far, x, n, 4, 0.95)
    assert (axes, route) == (1, 1) and within == ann.distance_needed(far, x, 4, 1, 0.95)
    assert ann.tuned(x[:0], x[:0], x[:0], n, 4, 0.95)[2] == 0
