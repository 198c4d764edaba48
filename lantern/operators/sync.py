"""A catalog of sources going over two tables, sources and their endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text
from lantern.operators import ranges
from lantern.operators.tables import kept

# Types of sources by those of the catalog, their weights, and how often endpoints are polled.
SOURCE_TYPES = {"chamber_html": "pharmacists_chamber", "json_api": "pharmacists_chamber", "third_party_html": "health_directorate"}
WEIGHTS = {"pharmacists_chamber": 90, "health_directorate": 85, "official_integration": 85, "manual": 70}
POLL = "*/30 * * * *"
SOURCE = ["id", "province_id", "name", "type", "authority_weight", "base_url", "enabled"]
ENDPOINT = ["id", "source_id", "endpoint_url", "format", "parser_key", "is_primary", "poll_cron", "enabled"]


def _with_ids(rows: DataFrame, table: DataFrame, found: str) -> DataFrame:
    """Adds id: the one found in the table, or the next ones after its greatest, in the order of the codes; and created."""
    rows = kept(rows)
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    new = ranges.placed(rows.where(F.col(found).isNull()).select("code"), [], [F.col("code")], "_k").join(F.broadcast(top), F.lit(True)).select("code", (F.col("_top") + F.col("_k")).cast("long").alias("_new"))
    return rows.join(new, "code", "left").withColumn("created", F.col(found).isNull()).withColumn(found, F.coalesce(found, "_new")).drop("_new")


def planned(catalog: DataFrame, provinces: DataFrame, sources: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A row for each entry of the catalog: province_id (null if there is no such province), source_id and endpoint_id, given
    before any row is written, and whether they are created. catalog: code, source_name, official_type, base_url,
    official_url, format, parser_key; a code stands for one province."""
    p = provinces.groupBy(F.lower("slug").alias("code")).agg(F.min("id").alias("province_id"))
    plan = catalog.join(p, "code", "left")
    s = sources.groupBy("province_id", F.col("name").alias("source_name")).agg(F.min("id").alias("source_id"))
    known = _with_ids(plan.where("province_id is not null").join(s, ["province_id", "source_name"], "left"), sources, "source_id").withColumnRenamed("created", "new_source")
    e = endpoints.groupBy("source_id", F.col("endpoint_url").alias("official_url")).agg(F.min("id").alias("endpoint_id"))
    known = _with_ids(known.join(e, ["source_id", "official_url"], "left"), endpoints, "endpoint_id").withColumnRenamed("created", "new_endpoint")
    kind = text.lookup(F.col("official_type"), SOURCE_TYPES, "manual")
    return kept(plan.where("province_id is null").unionByName(known, allowMissingColumns=True).withColumn("type", kind).withColumn("weight", text.lookup(kind, WEIGHTS, 70)))


def _over(plan: DataFrame, table: DataFrame, key: str, values: dict[str, Column], columns: list[str]) -> DataFrame:
    """The table with the plan's values where it names the row, and its new rows."""
    told = plan.where("province_id is not null").select(F.col(key).alias("id"), F.lit(True).alias("_told"), *[v.alias(f"_{c}") for c, v in values.items()])
    both = table.join(told, "id", "full_outer")
    return both.select(*[F.when(F.col("_told"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in columns])


def synced(catalog: DataFrame, provinces: DataFrame, sources: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables after the catalog went over them, and a row of counters with the codes of missing provinces.

    A source is told by its province and name, an endpoint by its source and address; those in the catalog get its values,
    new ones come in, others stay. Of a province only the catalog's endpoint stays primary.
    """
    plan = planned(catalog, provinces, sources, endpoints)
    c = F.col
    new_sources = _over(plan, sources, "source_id", {"province_id": c("province_id"), "name": c("source_name"), "type": c("type"), "authority_weight": c("weight"), "base_url": c("base_url"), "enabled": F.lit(True)}, SOURCE)
    told = {"source_id": c("source_id"), "endpoint_url": c("official_url"), "format": c("format"), "parser_key": c("parser_key"), "is_primary": F.lit(True), "poll_cron": F.lit(POLL), "enabled": F.lit(True)}
    new_endpoints = _over(plan, endpoints, "endpoint_id", told, ENDPOINT)
    keep = plan.where("province_id is not null").select("province_id", "endpoint_id")
    of = new_sources.select(c("id").alias("source_id"), "province_id").join(keep, "province_id")
    marked = kept(new_endpoints.join(of.select("source_id", "endpoint_id"), "source_id", "left").withColumn("_loses", F.coalesce(c("is_primary") & (c("id") != c("endpoint_id")), F.lit(False))))
    counted = plan.agg(
        F.count("*").alias("target_count"),
        F.count("province_id").alias("synced_count"),
        *[F.count_if(ok).alias(n) for n, ok in (("created_sources", c("new_source")), ("updated_sources", ~c("new_source")), ("created_endpoints", c("new_endpoint")), ("updated_endpoints", ~c("new_endpoint")))],
        F.array_join(F.array_sort(F.collect_list(F.when(c("province_id").isNull(), c("code")))), ",").alias("missing_provinces"),
    )  # what is missing are provinces, of which there are few
    summary = counted.join(marked.agg(F.count_if("_loses").alias("demoted_primary_endpoints")), F.lit(True))
    return new_sources, marked.select(*[(c("is_primary") & ~c("_loses")).alias(x) if x == "is_primary" else c(x) for x in ENDPOINT]), summary


DRIFTS = {"endpoint_url": "official_url", "parser_key": "parser_key", "format": "format"}


def overridden(endpoints: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endpoints (with the code of their province) with the catalog's address, parser and format, and the alerts: one where
    the catalog has no entry, whose endpoint stays as it is, or where they differ, with both values of each field as JSON."""
    entry = catalog.select("code", F.lit(True).alias("_there"), *[F.col(v).alias(f"_{k}") for k, v in DRIFTS.items()])
    both = endpoints.join(entry, "code", "left")
    differs = {k: ~F.col(k).eqNullSafe(F.col(f"_{k}")) for k in DRIFTS}
    out = both.select(*[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in DRIFTS else F.col(c) for c in endpoints.columns])
    pair = lambda k: F.struct(F.col(k).alias("db"), F.col(f"_{k}").alias("config"))
    drift = F.to_json(F.struct(*[F.when(differs[k], pair(k)).alias(k) for k in DRIFTS]))
    missing = F.col("_there").isNull()
    some = missing | differs["endpoint_url"] | differs["parser_key"] | differs["format"]
    alerts = both.where(some).select(
        "id", "code", F.when(missing, "source_config_missing").otherwise("source_config_drift").alias("alert_type"), F.lit("high").alias("severity"),
        F.when(missing, F.concat(F.lit("missing_source_catalog_entry:"), F.col("code"))).otherwise("db_source_endpoint_differs_from_catalog").alias("message"), F.when(~missing, drift).alias("payload"),
    )
    return out, alerts
