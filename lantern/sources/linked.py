"""Lists that a page only links to: the links of each page, joined by address to the table of fetched pages, and their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.operators.tables import dealt
from lantern.sources import catalog

#: Parts that the rows of an address are dealt over; its links go to each.
BLOCKS = 16


def links(pages: DataFrame, key: str, pattern: str) -> DataFrame:
    """key and url, each once, of the addresses in a page's html that a pattern matches."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(f"(?i){pattern}"), F.lit(0))
    return pages.select(key, F.explode(F.array_distinct(found)).alias("url"))


def references(pages: DataFrame, key: str, base: str) -> DataFrame:
    """key and url, each once, of all href and src of a page, made whole by the page's own address."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return pages.select(key, F.explode(F.array_distinct(F.transform(found, lambda x: catalog.resolved(F.col(base), x)))).alias("url"))


def rows(pages: DataFrame, fetched: DataFrame, key: str, pattern: str, parser: Callable[[Column], Column]) -> DataFrame:
    """The rows of all pages that a page links to, under its key. A linked page is parsed once, however many link to it; one
    that wasn't fetched has no rows. pages: key and html. fetched: url and html.

    The result has many more rows than both sides, so what counts is the room that they take where they are written. Each row
    of an address goes with all of its links at once: the row's values stand together, and the keys come in the same order
    after each, which encodings make short."""
    parsed = fetched.select("url", F.explode(parser(F.coalesce("html", F.lit("")))).alias("r"))
    parsed = parsed.select("url", F.pmod(F.xxhash64("r"), F.lit(BLOCKS)).cast("int").alias("block"), "r.*")
    found = links(pages, key, pattern).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    met = dealt(parsed, "url", "block").join(dealt(found, "url", "block").hint("shuffle_hash"), ["url", "block"])
    return met.drop("block")


def errors(pages: DataFrame, fetched: DataFrame, key: str, pattern: str) -> DataFrame:
    """Pages without links (no_links), and those some of whose linked pages are missing (missing_pages), with both counts."""
    there = fetched.select("url").distinct().withColumn("there", F.lit(1))
    found = links(pages, key, pattern).join(there, "url", "left").groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("lost"))
    none = F.lit(0).cast("long")
    out = pages.select(key).join(found, key, "left").select(key, F.coalesce("n", none).alias("n"), F.coalesce("lost", none).alias("lost"))
    return out.where("n = 0 or lost > 0").select(key, F.when(F.col("n") == 0, "no_links").otherwise("missing_pages").alias("error"), "n", "lost")
