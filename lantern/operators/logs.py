"""Logs as appended rows: runs, alerts, admin actions; changes of single columns; staleness and its alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import numbers, text


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """A log with more rows; columns that either lacks are null."""
    return log.unionByName(new, allowMissingColumns=True)


def alert_payload(payload: Column) -> Column:
    """JSON objects stay, nothing is an empty one, any other value is wrapped."""
    given = F.trim(payload)
    wrapped = F.concat(F.lit('{"value":'), given, F.lit("}"))
    return F.when(payload.isNull() | (given == "null"), "{}").when(given.startswith("{"), given).otherwise(wrapped)


def alert_rows(alerts: DataFrame, endpoints: DataFrame, provinces: DataFrame) -> DataFrame:
    """Alerts as they are stored. The province is the given one, else that of the slug, else that of the endpoint; without
    any, the alert isn't stored. An empty message is the alert's type.

    alerts: province_id, slug, endpoint_id, alert_type, severity, message, payload. endpoints: endpoint_id, e_province.
    provinces: slug, p_province. Both are small beside the alerts or not; they are joined by their keys.
    """
    found = alerts.join(provinces, "slug", "left").join(endpoints, "endpoint_id", "left")
    province = F.coalesce("province_id", "p_province", "e_province")
    message = F.coalesce(F.nullif(F.trim("message"), F.lit("")), "alert_type", F.lit("ingestion_alert"))
    out = found.select(*[c for c in alerts.columns if c not in ("province_id", "slug", "severity", "message", "payload")], province.alias("province_id"), text.severity(F.col("severity")).alias("severity"), message.alias("message"), alert_payload(F.col("payload")).alias("payload"))
    return out.where("province_id is not null")


def notified(alerts: DataFrame, sent: DataFrame, key: str, now: str) -> DataFrame:
    """Sets notified_at of the open alerts that were sent."""
    flag = sent.select(key).distinct().withColumn("_sent", F.lit(True))
    at = F.when(F.col("_sent") & F.col("notified_at").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("notified_at"))
    return alerts.join(flag, key, "left").withColumn("notified_at", at).drop("_sent")


def staleness_alerts(last: DataFrame, key: str, name: str, as_of: str) -> DataFrame:
    """Alerts for what had no success for too long: key, alert_type, severity, message and minutes. last: key, name and
    last_success_at, null if there was none; then the minutes count as 9999."""
    minutes = F.coalesce(numbers.minutes_since(F.col("last_success_at"), F.lit(as_of).cast("timestamp")), F.lit(9999.0))
    out = last.withColumn("m", minutes).where(F.col("m") > numbers.WARNING_MINUTES)
    critical, whole = F.col("m") > numbers.CRITICAL_MINUTES, numbers.half_up(F.col("m"))
    some = F.concat(F.lit("Son basarili ingest "), whole.cast("string"), F.lit(" dk once ("), F.col(name), F.lit(")"))
    none = F.concat(F.lit("Hic basarili ingest yok son 24 saatte ("), F.col(name), F.lit(")"))
    return out.select(key, F.when(critical, "freshness_breach").otherwise("stale_data").alias("alert_type"), F.when(critical, "high").otherwise("medium").alias("severity"), F.when(F.col("m") < 9000, some).otherwise(none).alias("message"), whole.alias("minutes"))


def stale_counts(alerts: DataFrame) -> DataFrame:
    """stale, critical and checked; only what is stale counts as checked."""
    critical = F.col("alert_type") == "freshness_breach"
    return alerts.agg(F.count_if(~critical).alias("stale"), F.count_if(critical).alias("critical"), F.count("*").alias("checked"))


def corrected(table: DataFrame, fixes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Point updates: the columns of the rows that fixes name, where it has a value."""
    named = fixes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return table.join(named, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def verdict(source_error: Column, api_error: Column, n_source: Column, n_api: Column, n_differences: Column) -> Column:
    """The outcome of comparing two lists; the first that holds."""
    return F.when(source_error | api_error, "ERROR").when(n_source == 0, "NO_SOURCE_DATA").when(n_api == 0, "NO_API_DATA").when(n_differences == 0, "PASS").otherwise("FAIL")


def single_verdict(has_endpoint: Column, source_error: Column, n_source: Column, api_error: Column, n_differences: Column) -> Column:
    """The same for one province, step by step."""
    return F.when(~has_endpoint, "NO_ENDPOINT").when(source_error, "SOURCE_ERROR").when(n_source == 0, "NO_SOURCE_DATA").when(api_error, "API_ERROR").when(n_differences == 0, "PASS").otherwise("FAIL")
