"""Places and carried values in groups of any size, as a window by group would give them, without a task for each group.

Rows are sorted by group and order into ranges, so a large group lies in many of them. What crosses the ranges is one row for
each group and range: how many rows it has there, or its first or last value. Windows go over these few, and within ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.tables import kept


def _ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with _at, which grows with the order, and _part, the range. A written table, so that it is cut once only."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    # with the number of ranges and rows in them set by the table, any later pass sees the same
    sorted_ = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return kept(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))


def _joined(rows: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(edges, same, "left").drop("_p", *[f"_k_{c}" for c in by])


def _edges(rows: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """One row for each group and range."""
    return rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_p")).agg(*aggregates)


def _over(by: list[str]) -> Window:
    """The ranges of a group before one."""
    return Window.partitionBy(*[f"_k_{c}" for c in by]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)


def placed(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row in its group, from 1. The order must be total, else equal rows get any place."""
    rows = _ranged(df, by, order)
    edges = _edges(rows, by, F.min("_at").alias("_first"), F.count("*").alias("_n"))
    edges = edges.withColumn("_before", F.coalesce(F.sum("_n").over(_over(by)), F.lit(0))).drop("_n")
    return _joined(rows, edges, by).withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_at", "_part", "_first", "_before")


def carried(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null of the group's rows up to each row, itself included."""
    rows = _ranged(df.withColumn("_v", value), by, order)
    edges = _edges(rows, by, F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_last"))
    edges = edges.withColumn("_old", F.last("_last", ignorenulls=True).over(_over(by))).drop("_last")
    within = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("_new", F.last("_v", ignorenulls=True).over(within))
    return _joined(told, edges, by).withColumn(name, F.coalesce("_new", "_old")).drop("_at", "_part", "_v", "_new", "_old")


def following(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the value of the group's next row; null for its last."""
    rows = _ranged(df.withColumn("_v", F.struct(value.alias("v"))), by, order)
    edges = _edges(rows, by, F.min_by("_v", "_at").alias("_head"))
    ahead = Window.partitionBy(*[f"_k_{c}" for c in by]).orderBy("_p")
    edges = edges.withColumn("_next_head", F.lead("_head").over(ahead)).drop("_head")
    within = Window.partitionBy("_part", *by).orderBy("_at")
    told = rows.withColumn("_next", F.lead("_v").over(within))
    return _joined(told, edges, by).withColumn(name, F.coalesce("_next", "_next_head")["v"]).drop("_at", "_part", "_v", "_next", "_next_head")
