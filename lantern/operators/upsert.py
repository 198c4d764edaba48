"""Upserts and other changes of keyed tables, as joins that give the table's new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def given(new: Column, old: Column) -> Column:
    """New unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def upsert_places(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Keys district_id and normalized_name. The new name always holds, address and phone unless empty, lat and lng unless
    null; what a batch names is active. Later rows of a batch (by ord) go over earlier ones. Both shuffle by key once."""
    keys = ["district_id", "normalized_name"]
    latest = lambda c, ok: F.max_by(c, F.when(ok, F.col("ord")))
    new = batch.groupBy(*keys).agg(
        F.max_by("canonical_name", "ord").alias("n_name"),
        *[latest(c, F.col(c).isNotNull() & (F.col(c) != "")).alias(f"n_{c}") for c in ("address", "phone")],
        *[latest(c, F.col(c).isNotNull()).alias(f"n_{c}") for c in ("lat", "lng")],
        F.lit(True).alias("n_active"),
    )
    both = existing.join(new, keys, "full_outer")
    return both.select(
        *keys,
        F.coalesce("n_name", "canonical_name").alias("canonical_name"),
        *[given(F.col(f"n_{c}"), F.col(c)).alias(c) for c in ("address", "phone")],
        *[F.coalesce(f"n_{c}", c).alias(c) for c in ("lat", "lng")],
        F.coalesce("n_active", "is_active").alias("is_active"),
    )


def upsert_duties(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Keys place_id and duty_date. The confidence is the greatest, the number of sources grows by one for each row, the
    newest district holds, and what a batch names is not degraded."""
    keys = ["place_id", "duty_date"]
    new = batch.groupBy(*keys).agg(F.max("confidence").alias("n_confidence"), F.count("*").alias("n_rows"), F.max_by("district_id", "ord").alias("n_district"))
    return existing.join(new, keys, "full_outer").select(
        *keys,
        F.greatest("confidence", "n_confidence").alias("confidence"),
        (F.coalesce("sources", F.lit(0)) + F.coalesce("n_rows", F.lit(0))).cast("long").alias("sources"),
        F.coalesce("n_district", "district_id").alias("district_id"),
        F.when(F.col("n_rows").isNotNull(), False).otherwise(F.col("is_degraded")).alias("is_degraded"),
    )


def upsert_evidence(log: DataFrame, keys: list[str]) -> DataFrame:
    """Of repeated evidence the last time it was seen and the first payload."""
    return log.groupBy(*keys).agg(F.max("seen_at").alias("seen_at"), F.min_by("payload", F.struct("seen_at", "payload")).alias("payload"))


def delete_stale(existing: DataFrame, kept: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Rows that stay: in a scope that kept names completely (complete), only those whose key it names."""
    scopes = kept.groupBy(*scope).agg(F.bool_and("complete").alias("complete"))
    named = kept.select(*scope, key).distinct().withColumn("named", F.lit(True))
    both = existing.join(scopes, scope, "left").join(named, [*scope, key], "left")
    return both.where("named or not coalesce(complete, false)").drop("complete", "named")


def demote_others(endpoints: DataFrame, keep: DataFrame) -> DataFrame:
    """Of each source only the kept endpoint stays primary; changed marks the rows that lose it."""
    both = endpoints.join(keep, "source_id", "left")
    loses = F.col("is_primary") & (F.col("id") != F.col("keep_id"))
    return both.withColumn("changed", F.coalesce(loses, F.lit(False))).withColumn("is_primary", F.col("is_primary") & ~F.col("changed")).drop("keep_id")


def sync_actions(catalog: DataFrame, existing: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """What a catalog asks for each key: insert, update (with the drifted columns), none, or unknown if it isn't there."""
    c, e = catalog.select(key, F.lit(1).alias("_c"), *[F.col(x).alias(f"c_{x}") for x in compared]), existing.select(key, F.lit(1).alias("_e"), *compared)
    drift = F.filter(F.array(*[F.when(~F.col(f"c_{x}").eqNullSafe(F.col(x)), F.lit(x)) for x in compared]), lambda x: x.isNotNull())
    action = F.when(F.col("_e").isNull(), "insert").when(F.col("_c").isNull(), "unknown").when(F.size(drift) > 0, "update").otherwise("none")
    return c.join(e, key, "full_outer").select(key, action.alias("action"), F.when(action == "update", F.array_join(drift, ",")).otherwise("").alias("drift"))


def synced(catalog: DataFrame, existing: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table after a catalog went over it: the catalog's values where it has the key, and change: created, updated, same,
    or kept for what the catalog doesn't name."""
    c, e = catalog.select(key, F.lit(1).alias("_c"), *[F.col(x).alias(f"c_{x}") for x in columns]), existing.select(key, F.lit(1).alias("_e"), *columns)
    drift = F.lit(False)
    for x in columns:
        drift = drift | ~F.col(f"c_{x}").eqNullSafe(F.col(x))
    change = F.when(F.col("_e").isNull(), "created").when(F.col("_c").isNull(), "kept").when(drift, "updated").otherwise("same")
    return c.join(e, key, "full_outer").select(key, *[F.when(F.col("_c").isNull(), F.col(x)).otherwise(F.col(f"c_{x}")).alias(x) for x in columns], change.alias("change"))


def sync_counters(changed: DataFrame) -> DataFrame:
    return changed.agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("created", "updated", "same", "kept")])


def failures_in_a_row(runs: DataFrame, key: str, ts: str, ok: Column) -> DataFrame:
    """State after all runs of a key: last success, failures since, and healthy: none failed since, or fewer than three
    after some success; a key that has only failed is unhealthy from the first one. One shuffle, no order is needed."""
    last = runs.groupBy(key).agg(F.max(F.when(ok, F.col(ts))).alias("last_success_at"), F.max(ts).alias("last_attempt_at"))
    since = runs.join(last, key).where(F.col("last_success_at").isNull() | (F.col(ts) > F.col("last_success_at"))).groupBy(key).agg(F.count(F.when(~ok, 1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    healthy = F.when(n == 0, True).when(F.col("last_success_at").isNull() & (n < 3), False).otherwise(n < 3)
    return last.join(since, key, "left").select(key, "last_success_at", "last_attempt_at", n.alias("consecutive_failures"), healthy.alias("is_healthy"))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
