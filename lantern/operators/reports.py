"""Views and reports over the directory's tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import numbers, text
from lantern.operators import ranges


def nearest(places: DataFrame, key: str, lat0: float, lng0: float, n: int = 10, km: float = 50.0) -> DataFrame:
    """The n nearest places inside the square, with distance_km; ties by key. A top-n, so no full sort."""
    lat, lng = F.col("lat"), F.col("lng")
    found = places.where(lat.isNotNull() & lng.isNotNull() & numbers.in_box(lat, lng, lat0, lng0, km))
    found = found.withColumn("_d", numbers.distance_km(lat, lng, lat0, lng0)).orderBy("_d", key).limit(n)
    return found.withColumn("distance_km", F.round("_d", 3)).drop("_d")


def active_duties(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame, lineitem: DataFrame, supplier: DataFrame, day: str) -> DataFrame:
    """The duties of a day with their place, province and region, their sources by name, and when they were first seen.
    The day's filter reaches the scan, so only its duties meet the evidence."""
    duties = orders.where(F.col("o_orderdate") == F.lit(day).cast("timestamp"))
    full = duties.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    full = full.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    names = F.array_sort(F.collect_set("s_name"))
    return full.groupBy("o_orderkey", "c_name", "n_name", "r_name").agg(F.array_join(names, ", ").alias("sources"), F.min("l_shipdate").alias("first_seen"), F.countDistinct("l_suppkey").alias("n_sources"))


def match_summary(matches: DataFrame) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("match_type").isin(*kinds))
    mean = F.coalesce(F.round(F.avg("confidence"), 2), F.lit(0.0))
    return matches.agg(F.count("*").alias("total"), n("exact").alias("exact"), n("fuzzy", "normalized").alias("fuzzy"), n("no_match").alias("no_match"), mean.alias("mean"))


def sitemap_urls(df: DataFrame, location: Column, changed: Column, today: str) -> DataFrame:
    """Adds xml, the entry of each row; without a change it counts as changed today."""
    day = F.date_format(F.coalesce(changed, F.lit(today).cast("timestamp")), "yyyy-MM-dd")
    return df.withColumn("xml", F.concat(F.lit("<url><loc>"), text.escape_xml(location), F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>")))


def day_or_latest(keys: DataFrame, days: DataFrame, key: str, today: str) -> DataFrame:
    """Each key's day: today if it has rows of today, else its latest; status today, latest or no_data."""
    wanted = F.lit(today).cast("date")
    found = days.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("day") == wanted, F.col("day"))), F.max("day")).alias("day"))
    status = F.when(F.col("day") == wanted, "today").when(F.col("day").isNull(), "no_data").otherwise("latest")
    return keys.join(found, key, "left").select(key, "day", status.alias("status"))


# The kinds of faults that a correction report may tell of.
ISSUES = ["telefon_yanlis", "adres_yanlis", "nobette_degil", "kapali", "diger"]


def report_valid(province: Column, place: Column, issue: Column) -> Column:
    """Whether a correction report names a province and a place by two letters or more, and a known kind of fault."""
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    return (size(province) >= 2) & (size(place) >= 2) & F.trim(F.coalesce(issue, F.lit(""))).isin(ISSUES)


def report_note(note: Column, most: int = 1000) -> Column:
    return F.substring(F.trim(F.coalesce(note, F.lit(""))), 1, most)


def run_alerts(runs: DataFrame, key: str) -> DataFrame:
    """A row for each rule that a run breaks: partial_data, no_data and, if it covers less than 0.8 of what is expected,
    mismatch_count. runs: key, status, upserted, covered, expected (nothing is known if it is null or 0)."""
    share = F.col("covered") / F.nullif(F.col("expected"), F.lit(0))
    rules = [
        (F.col("status") == "partial", "partial_data", F.lit("medium")),
        ((F.col("status") == "no_data") | (F.col("upserted") == 0), "no_data", F.lit("high")),
        (share < 0.8, "mismatch_count", F.when(share < 0.5, "high").otherwise("medium")),
    ]
    made = F.array(*[F.when(when, F.struct(F.lit(kind).alias("alert_type"), severity.alias("severity"))) for when, kind, severity in rules])
    return runs.select(key, F.explode(F.array_compact(made)).alias("a")).select(key, "a.*")


def correction_reports(sent: DataFrame, provinces: DataFrame, districts: DataFrame) -> DataFrame:
    """Valid reports with the ids of their province, without which they aren't stored, and of their district in it, if it has
    such a one; both by slugs. sent: il, ilce, name, issue and more; provinces: slug, province_id; districts: province_id,
    slug, district_id."""
    good = sent.where(report_valid(F.col("il"), F.col("name"), F.col("issue"))).withColumn("issue", F.trim("issue"))
    good = good.join(provinces.withColumnRenamed("slug", "_il"), text.slugify(F.col("il")) == F.col("_il")).drop("_il")
    some = F.when(F.trim(F.coalesce("ilce", F.lit(""))) != "", text.slugify(F.col("ilce")))
    return good.withColumn("_ilce", some).join(districts.withColumnRenamed("slug", "_ilce"), ["province_id", "_ilce"], "left").drop("_ilce")


def fingerprints(names: DataFrame) -> DataFrame:
    """key, n and fingerprint of each list: the first eight digits of the md5 of its sorted names, joined by a bar. A list is
    read as a stream in the order of its names; no row or group holds it. names: key, a string, and name; nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, digest = None, 0, hashlib.md5()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([n], pa.int64()), pa.array([digest.hexdigest()[:8]])], ["key", "n", "fingerprint"])

        for batch in batches:
            for k, name in zip(batch["key"].to_pylist(), batch["name"].to_pylist(), strict=True):
                if k != key:
                    if n:
                        yield done()
                    key, n, digest = k, 0, hashlib.md5()
                digest.update((f"|{name}" if n else name).encode())
                n += 1
        if n:
            yield done()

    some = names.select("key", "name").where("key is not null and name is not null")
    return some.repartition("key").sortWithinPartitions("key", "name").mapInArrow(run, "key string, n long, fingerprint string")


def _document(body: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), body, F.lit("\n"))


def feed_pages(rows: DataFrame, order: list[Column], location: Column, changed: Column, today: str, frequency: str, priority: str | Column, size: int, site: str) -> DataFrame:
    """page and xml, the urlset of each page of so many rows in their order; without a change a row counts as changed today.
    Places come from ranges, so no task sorts the whole feed, and a page is a row of bounded size."""
    entry = F.concat(
        F.lit("  <url>\n    <loc>"), text.escape_xml(F.when(location.startswith("http"), location).otherwise(F.concat(F.lit(site), location))),
        F.lit("</loc>\n    <lastmod>"), F.date_format(F.coalesce(changed, F.lit(today).cast("timestamp")), "yyyy-MM-dd"),
        F.lit(f"</lastmod>\n    <changefreq>{frequency}</changefreq>\n    <priority>"), F.lit(priority) if isinstance(priority, str) else priority, F.lit("</priority>\n  </url>"),
    )
    at = ranges.placed(rows.withColumn("_entry", entry), [], order, "_place").select(((F.col("_place") - 1) / size + 1).cast("int").alias("page"), "_place", "_entry")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_entry"))), lambda x: x["_entry"])
    whole = at.groupBy("page").agg(F.array_join(entries, "\n").alias("_all"))
    return whole.select("page", _document(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'), "_all", F.lit("\n</urlset>"))).alias("xml"))


def unchanged(rows: DataFrame) -> DataFrame:
    """What stands in for rows with their changes where no table has these."""
    return rows.withColumn("changed", F.lit(None).cast("timestamp"))


def feed_index(rows: DataFrame, others: list[str], paged: str, size: int, today: str, site: str) -> DataFrame:
    """The index of the feeds: others, and as many pages of a paged one as its rows need, one at least."""
    pages = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("n"))
    named = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.when(k == 1, F.lit(paged)).otherwise(F.concat(F.lit(f"{paged}-"), k.cast("string"))))
    entries = F.transform(F.concat(F.array(*map(F.lit, others)), named), lambda x: F.concat(F.lit(f"  <sitemap>\n    <loc>{site}/sitemap-"), text.escape_xml(x), F.lit(f".xml</loc>\n    <lastmod>{today}</lastmod>\n  </sitemap>")))
    return pages.select(_document(F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'), F.array_join(entries, "\n"), F.lit("\n</sitemapindex>"))).alias("xml"))
