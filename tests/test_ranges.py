"""Places and carried values over ranges against windows by group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lantern.operators import ranges, reports


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    data = [(draw.choice([1, 1, 1, 1, 2, 3, None]), draw.randint(0, 5), i, draw.choice([None, None, None, i])) for i in range(4000)]
    return spark.createDataFrame(data, "g int, a int, id long, v long").repartition(5)


def order():
    return [F.col("a"), F.col("id")]


def test_places_and_carried_values(rows):
    w = Window.partitionBy("g").orderBy(*order())
    want = rows.withColumns({"place": F.row_number().over(w), "last": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("v").over(w)})
    got = ranges.placed(ranges.carried(ranges.following(rows, ["g"], order(), F.col("v"), "next"), ["g"], order(), F.col("v"), "last"), ["g"], order())
    columns = ["g", "a", "id", "v", "place", "last", "next"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)


def test_a_large_group_lies_in_many_ranges(rows):
    assert ranges._ranged(rows, ["g"], order()).where("g = 1").select("_part").distinct().count() > 1


def test_no_groups_and_no_rows(rows):
    got = ranges.placed(rows, [], [F.desc("id")], "k").select("id", "k").collect()
    assert {r["id"]: r["k"] for r in got} == {i: 4000 - i for i in range(4000)}
    none = rows.limit(0)
    assert ranges.placed(none, ["g"], order()).count() == ranges.carried(none, ["g"], order(), F.col("v"), "l").count() == ranges.following(none, ["g"], order(), F.col("v"), "n").count() == 0


def test_feed_pages_and_index(spark):
    df = spark.createDataFrame([(f"/a&{i:02d}", None) for i in range(5)] + [("https://o.example/x", "2024-02-03")], "loc string, day string")
    got = reports.feed_pages(df, [F.col("loc")], F.col("loc"), F.col("day").cast("timestamp"), "2024-01-31", "daily", "0.5", 4, "https://x.example").orderBy("page").collect()
    assert [r["page"] for r in got] == [1, 2] and got[0]["xml"].count("<url>") == 4 and got[1]["xml"].count("<url>") == 2
    assert got[0]["xml"].startswith('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n  <url>\n    <loc>https://x.example/a&amp;00</loc>\n    <lastmod>2024-01-31</lastmod>\n    <changefreq>daily</changefreq>\n    <priority>0.5</priority>\n  </url>\n')
    assert "<loc>https://o.example/x</loc>\n    <lastmod>2024-02-03</lastmod>" in got[1]["xml"] and got[1]["xml"].endswith("  </url>\n</urlset>\n")
    index = reports.feed_index(df, ["static"], "lists", 4, "2024-01-31", "https://x.example").first()["xml"]
    assert [x.split("<")[0] for x in index.split("<loc>")[1:]] == [f"https://x.example/sitemap-{n}.xml" for n in ("static", "lists", "lists-2")]
    assert reports.feed_index(df.limit(0), [], "lists", 4, "2024-01-31", "x").first()["xml"].count("<sitemap>") == 1


def test_fingerprints_of_whole_lists(spark):
    import hashlib

    names = [(k, f"n{i % 37}") for i in range(500) for k in ("a", "b")] + [("c", "ş"), ("c", None), ("d", None), (None, "x")]
    got = {r["key"]: (r["n"], r["fingerprint"]) for r in reports.fingerprints(spark.createDataFrame(names, "key string, name string")).collect()}
    want = {k: sorted(n for key, n in names if key == k and n is not None) for k in "abc"}
    assert got == {k: (len(v), hashlib.md5("|".join(v).encode()).hexdigest()[:8]) for k, v in want.items()}
