"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns the vectors by several fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and
assigns each to the signed axis nearest to it in every one; the axes together are its bucket. Their number may grow with the
logarithm of the number of vectors, so that buckets stay small; a sample tells which number meets the fewest. A query probes buckets in the order of their distance, the
sum over the rotations of how much farther the bucket's axis is than the nearest one, up to a distance that is set by the
recall of a sample; what shares one of them with it is a candidate and is reranked by its exact inner product. For largest
inner products the vectors get one more component that makes all of one length, so that the nearest on the sphere has the
largest product; unit vectors stay as they are.

Buckets with the same first axes meet in one task, so a vector travels once for each table and a query once for each such
group in which it probes a bucket; which ones these are is told there. How many axes make a group is set by the sample: with
more of them groups are smaller, but a query goes to more of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import map_batches, spread, written

SEED = 20240229
#: Vectors, and queries, that meet in one task; rows that a task sends at once.
BLOCK = 4096
#: Rotations that a table can have. Vectors that a group of buckets is meant to hold.
MOST_AXES, GROUP = 8, 256
#: Lengths that differ by so small a share are equal but for rounding to single precision.
ROUNDING = 1e-3


def signs(dim: int, table: int, seed: int = SEED) -> np.ndarray:
    """The signs of the three rounds of a table's rotation; dim is a power of two."""
    return np.random.default_rng([seed, table]).choice(np.array([-1.0, 1.0]), (3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    rows, dim = x.shape
    step = 1
    while step < dim:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, dim)
        step *= 2
    return x / np.sqrt(dim)


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    for s in signs(x.shape[1], table, seed):
        x = hadamard(x * s)
    return x


def distances(x: np.ndarray, table: int, axes: int, seed: int = SEED) -> np.ndarray:
    """vector, rotation, signed axis (a, and a + dim for its negative): how much farther it is than the nearest."""
    out = []
    for k in range(axes):
        y = rotate(x, table * MOST_AXES + k, seed)
        both = np.concatenate([y, -y], axis=1)
        out.append(both.max(axis=1, keepdims=True) - both)
    return np.stack(out, axis=1)


def codes(x: np.ndarray, table: int, axes: int, seed: int = SEED) -> np.ndarray:
    """The signed axis nearest to each vector in each of a table's rotations."""
    return distances(x, table, axes, seed).argmin(axis=2)


def probed(distance: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one query, the groups (all axes but the last as one number) with a bucket within that distance, and for each
    group which of its last axes are. distance: rotation, axis."""
    group, far = np.zeros(1, np.int64), np.zeros(1)
    for d in distance[:-1]:
        near = np.flatnonzero(d <= within)
        far = (far[:, None] + d[near]).ravel()
        group = (group[:, None] * distance.shape[1] + near).ravel()
        group, far = group[far <= within], far[far <= within]
    return group, far[:, None] + distance[-1] <= within


def routed(distance: np.ndarray, within: float, route: int) -> np.ndarray:
    """Of one query, the groups (the first `route` axes as one number) that it goes to."""
    group, some = probed(distance[:route], within)
    i, last = np.nonzero(some)
    return group[i] * distance.shape[1] + last


def reached(x: np.ndarray, table: int, part: int, rest: np.ndarray, route: int, axes: int, within: float, seed: int = SEED) -> np.ndarray:
    """query, vector: which vectors of a group lie in a bucket that a query probes. rest: their axes after the first `route`."""
    d, far = distances(x, table, axes, seed), np.zeros((len(x), 1))
    for k in range(axes):
        code, left = (np.full(1, part), route - 1 - k) if k < route else (rest, axes - 1 - k)
        far = far + d[:, k][:, code // d.shape[2] ** left % d.shape[2]]
    return far <= within


def _padded(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (of single precision, if the column is) and its squared length, without vectors that are null, empty, zero, or hold null or non-finite
    components."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    df = df.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    df = df.withColumn("norm2", F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))"))
    return df.where("norm2 > 0 and norm2 < double('infinity')")


def index(vectors: DataFrame, largest: float, dim: int, tables: int, axes: int, route: int, seed: int = SEED) -> DataFrame:
    """Every vector once for each table: tbl, part (its group, by the first `route` axes), rest (its other axes), vec_id, v.
    largest: the largest squared length."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        y, part, rest = lifted(_matrix(batch["v"]), largest, dim), [], []
        for t in range(tables):
            code = codes(y, t, axes, seed)
            part.append(code[:, :route] @ (2 * dim) ** np.arange(route - 1, -1, -1))
            rest.append(code[:, route:] @ (2 * dim) ** np.arange(axes - route - 1, -1, -1))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(y))), pa.array(np.concatenate(part).astype(np.int64)), pa.array(np.concatenate(rest).astype(np.int64)), pa.array(np.tile(batch["vec_id"].to_numpy(), tables)), pa.concat_arrays([batch["v"]] * tables)],
            ["tbl", "part", "rest", "vec_id", "v"],
        )

    return map_batches(vectors.select("vec_id", "v"), run, f"tbl int, part long, rest long, vec_id long, v {vectors.schema['v'].dataType.simpleString()}")


def lifted(x: np.ndarray, largest: float, dim: int) -> np.ndarray:
    """With the component that makes all of one length. Lengths that differ by rounding only count as equal, else unit
    vectors would get noise as a component."""
    short = np.sqrt(np.maximum(largest - (x * x).sum(1), 0))
    short[short < ROUNDING * np.sqrt(largest)] = 0
    return _padded(np.column_stack([x, short])[:, :dim], dim)


def probes(queries: DataFrame, dim: int, tables: int, axes: int, route: int, within: float, seed: int = SEED) -> DataFrame:
    """Every query once for each group with a bucket that it probes: tbl, part, query_id, v. Rows are sent as they are made,
    as a batch of queries goes to many times its number of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            x, held, take, tbl = _padded(_matrix(batch["v"]), dim), [], [], []

            def made() -> pa.RecordBatch:
                at = pa.array(np.concatenate(take))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tbl)), pa.array(np.concatenate(held)), batch["vec_id"].take(at), batch["v"].take(at)], ["tbl", "part", "query_id", "v"])  # noqa: B023

            size = 0
            for t in range(tables):
                for i, d in enumerate(distances(x, t, axes, seed)):
                    group = routed(d, within, route)
                    for begin in range(0, len(group), BLOCK):
                        some = group[begin : begin + BLOCK]
                        held.append(some)
                        take.append(np.full(len(some), i))
                        tbl.append(np.full(len(some), t, np.int32))
                        size += len(some)
                        if size >= BLOCK:
                            yield made()
                            held, take, tbl, size = [], [], [], 0
            if size:
                yield made()

    return queries.select("vec_id", "v").mapInArrow(run, f"tbl int, part long, query_id long, v {queries.schema['v'].dataType.simpleString()}")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_in(q: pd.DataFrame, v: pd.DataFrame, k: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pd.DataFrame:
    """The k nearest of some vectors for each of some queries, ties to the smaller id; with `near`, of queries and the
    vectors' rest, only those pairs that it says. A matrix product gives the shortlist; its scores are then taken again pair
    by pair, in one order of additions, so that equal vectors tie."""
    empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    if q.empty or v.empty:
        return empty
    v = v.sort_values("vec_id").reset_index(drop=True)
    x, y = (np.stack(df["v"].to_numpy()).astype(np.float64) for df in (q, v))
    ids, own = v["vec_id"].to_numpy(), q["query_id"].to_numpy()
    out = []
    for at in range(0, len(x), 256):
        some = x[at : at + 256]
        s = some @ y.T
        s[own[at : at + 256, None] == ids[None, :]] = -np.inf
        if near is not None:
            s[~near(some, v["rest"].to_numpy())] = -np.inf
        n = min(k, len(y))
        least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        slack = 1e-12 * np.linalg.norm(some, axis=1) * np.sqrt((y * y).sum(1).max())
        i, j = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        score = np.concatenate([(some[i[b : b + 65536]] * y[j[b : b + 65536]]).sum(1) for b in range(0, len(i), 65536)] or [np.empty(0)])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        out.append(pd.DataFrame({"query_id": own[at : at + 256][i[keep]], "vec_id": ids[j[keep]], "score": score[keep]}))
    return pd.concat(out)


def sampled(vectors: DataFrame, queries: DataFrame, k: int, largest: float, dim: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sample of so many queries (those of the smallest hashes) the vectors, their k nearest by brute force over all
    vectors, and the query of each of these."""
    chosen = queries.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    asked = pd.DataFrame({"query_id": chosen["vec_id"], "v": chosen["v"]})

    def run(batches):
        held = []  # the nearest of the task so far: k rows a query
        for batch in batches:
            some = pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "v": list(_matrix(batch["v"]))})
            near = nearest_in(asked, some, k)
            near["v"] = near["vec_id"].map(dict(zip(some["vec_id"], some["v"], strict=True)))
            best = pd.concat([*held, near]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            held = [best.groupby("query_id").head(k)]
        for near in held:
            yield pa.RecordBatch.from_pandas(near, preserve_index=False)

    near = vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double, v array<double>")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "v").toPandas()
    if true.empty:
        return (np.empty((0, dim)),) * 3
    of = np.stack(asked.set_index("query_id").loc[true["query_id"], "v"].to_numpy())
    return _padded(np.stack(asked["v"].to_numpy()), dim), lifted(np.stack(true["v"].to_numpy()), largest, dim), _padded(of, dim)


def distance_needed(true: np.ndarray, of: np.ndarray, tables: int, axes: int, recall: float, seed: int = SEED) -> float:
    """How far a query must probe to find that share of its nearest: the distance of each one's bucket in its nearest table."""
    if not len(true):
        return 0.0
    far = np.full(len(true), np.inf)
    for t in range(tables):
        code, d = codes(true, t, axes, seed), distances(of, t, axes, seed)
        far = np.minimum(far, np.take_along_axis(d, code[:, :, None], 2)[:, :, 0].sum(axis=1))
    return float(np.quantile(far, recall, method="higher")) + 1e-9


def tuned(asked: np.ndarray, true: np.ndarray, of: np.ndarray, n: int, tables: int, recall: float, seed: int = SEED) -> tuple[int, int, float]:
    """How many axes a bucket has, of how many of them groups are made, and how far queries probe, so that the sample's
    queries meet the fewest vectors with so much recall. To be sent to a group counts as GROUP vectors. More axes tell vectors
    apart better, but where neighbours are far a query probes most groups of them."""
    ways = []
    for axes in range(1, axes_for(n, asked.shape[1]) + 1):
        within = distance_needed(true, of, tables, axes, recall, seed)
        far = [distances(asked, t, axes, seed) for t in range(tables)] if len(asked) else []
        for route in range(1, max(axes - 1, 1) + 1):
            groups = sum(len(routed(d, within, route)) for table in far for d in table)
            ways.append((groups * (GROUP + n / (2 * asked.shape[1]) ** route), axes, route, within))
    return min(ways)[1:]


def axes_for(n: int, dim: int, group: int = GROUP) -> int:
    """The most axes: so many that the groups of buckets hold about so many vectors, one for the last axis, more by the logarithm."""
    return min(MOST_AXES, 1 + max(1, round(np.log(max(n / group, 1)) / np.log(2 * dim))))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 8, recall: float = 0.95, sample: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query by inner product, in double precision.

    Queries are rows like the vectors; a row is no candidate of itself (by id). Ties go to the smaller vec_id; only where
    there are fewer than k candidates a query has fewer rows. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do rows without id, nor vectors of another length than most have (the larger
    length, if two are as frequent). Of a repeated id the smallest vector counts; repeated vectors count each. How far a
    query probes is set by the recall that a bounded sample of queries has against brute force, so it follows the data and
    their number. A query that finds fewer than k so is compared with all vectors, in blocks. No bucket is capped: a group
    of more than block vectors, or queries, is dealt to more tasks, each pair of blocks to one. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def once(df: DataFrame) -> DataFrame:
        return usable(spread(df), id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"), F.min_by("norm2", "v").alias("norm2"))

    every = written(once(vectors), "vectors")
    dims = every.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good, asked = (df.where(F.size("v") == dims["dim"]) for df in (every, once(queries)))
    asked = written(asked, "queries")
    size = good.agg(F.max("norm2").alias("most"), F.min("norm2").alias("least"), F.count("*").alias("n")).first()
    uneven = np.sqrt(max(size["most"] - size["least"], 0)) >= ROUNDING * np.sqrt(size["most"])
    dim = 1 << max(int(dims["dim"] + uneven - 1).bit_length(), 2)
    axes, route, within = tuned(*sampled(good, asked, k, size["most"], dim, sample), size["n"], tables, recall)
    schema = "query_id long, vec_id long, score double"
    keys = ["tbl", "part", "v_block", "q_block"]

    def met(placed: DataFrame, asking: DataFrame, hashed: bool = True) -> DataFrame:
        """The nearest of each query in each group that it meets; if hashed, in the buckets that it probes there."""
        # how many blocks each group needs; groups are far fewer than vectors
        many = placed.groupBy("tbl", "part").count().select("tbl", "part", F.ceil(F.col("count") / block).alias("v_blocks"))
        asks = asking.groupBy("tbl", "part").count().select("tbl", "part", F.ceil(F.col("count") / block).alias("q_blocks"))
        plan = written(many.join(asks, ["tbl", "part"]), "groups")

        def dealt(df: DataFrame, key: str, own: str, other: str, *more: str) -> DataFrame:
            """Each row in its own block, once for each block of the other side."""
            df = df.join(plan, ["tbl", "part"]).withColumn(own, F.pmod(F.xxhash64(key), f"{own}s").cast("int"))
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(f"{other}s") - 1).cast("int")))).select(*keys, key, "v", *more)

        def nearest(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            return nearest_in(q, v, k, (lambda x, rest: reached(_padded(x, dim), int(key[0]), int(key[1]), rest, route, axes, within)) if hashed and route < axes else None)

        left = dealt(asking, "query_id", "q_block", "v_block").groupBy(*keys)
        right = dealt(placed, "vec_id", "v_block", "q_block", *["rest"] * hashed).groupBy(*keys)
        return left.cogroup(right).applyInPandas(nearest, schema)

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = written(ranked(met(index(good, size["most"], dim, tables, axes, route), probes(asked, dim, tables, axes, route, within))), "found")
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, size["n"] - 1))
    few = asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti")
    if few.isEmpty():
        return found
    nowhere = [F.lit(0).alias("tbl"), F.lit(0).cast("long").alias("part")]
    rest = met(good.select(*nowhere, "vec_id", "v"), few.select(*nowhere, F.col("vec_id").alias("query_id"), "v"), hashed=False)
    return found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(ranked(rest))
