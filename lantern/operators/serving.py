"""Lists as they are served: by province and district with a table to fall back to, their order, summaries and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import text


def with_fallback(view: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """The view's rows, and those of the table for the keys of which the view has none."""
    return view.unionByName(table.join(view.select(*key).distinct(), key, "left_anti"))


def on_day(duties: DataFrame, day: str, column: str = "duty_date") -> DataFrame:
    return duties.where(F.col(column) == F.lit(day).cast("date"))


def placed(rows: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
    """Adds place, from 1, in the order of a list within its parts."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))


def turkish(c: str) -> Column:
    """For sorting as in Turkish."""
    return F.collate(F.col(c), "tr")


def sorted_names(names: Column) -> Column:
    """A list without repeats and blanks, in the order of code units."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")))


def in_district(rows: DataFrame, district: Column, selected: Column) -> DataFrame:
    """Rows of the selected district by slug; all if none is selected."""
    return rows.where((F.coalesce(selected, F.lit("")) == "") | (text.slugify(district) == selected))


def finite(lat: Column, lng: Column) -> Column:
    """Whether a place can be put on a map."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok(lat) & ok(lng)


def province_name(name: Column, slug: Column) -> Column:
    """The name, else the slug with a capital."""
    return F.coalesce(name, F.concat(F.upper(F.substring(slug, 1, 1)), slug.substr(F.lit(2), F.length(slug))))


def degraded(message: Column) -> Column:
    """What is served if nothing can be: a payload without data."""
    none = F.lit(None).cast("string")
    info = F.struct(none.alias("last_successful_update"), none.alias("stale_minutes"), none.alias("recent_alert"), message.alias("hint"))
    return F.struct(F.lit("degraded").alias("status"), none.alias("duty_date"), none.alias("son_guncelleme"), info.alias("degraded_info"), F.array().cast("array<string>").alias("data"))


def view_missing(code: Column, message: Column) -> Column:
    """Whether an error says that the view isn't there."""
    return F.coalesce(code == "42P01", F.lit(False)) | F.coalesce(F.contains(message, F.lit("api_active_duty")), F.lit(False))


def source_summary(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The source of the first row of each list, and the greatest number of verifications."""
    first = F.min_by(F.struct("source", "updated"), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("f"), F.max("verifications").alias("verifications")).select(key, F.coalesce("f.source", F.lit("Bilinmiyor")).alias("source"), F.col("f.updated").alias("updated"), "verifications")


def snapshot(rows: DataFrame, key: str) -> DataFrame:
    """status, day, last update and number of rows of each list."""
    return rows.groupBy(key).agg(F.coalesce(F.max("status"), F.lit("unknown")).alias("status"), F.max("day").alias("day"), F.max("updated").alias("updated"), F.count("name").alias("n"))


def without_flags(rows: DataFrame) -> DataFrame:
    """The row as JSON without is_degraded; coordinates only where there are any."""
    return rows.withColumn("json", F.to_json(F.struct(*[c for c in rows.columns if c != "is_degraded"])))


def row_defaults() -> list[Column]:
    """The served names of a row's district, source and address, with what stands for a missing one."""
    return [F.coalesce(F.nullif("district", F.lit("")), F.lit("Merkez")).alias("ilce"), F.coalesce("source", F.lit("Bilinmiyor")).alias("kaynak"), F.coalesce("address", F.lit("")).alias("adres")]
