from itertools import groupby

from pyspark.sql import functions as F

from lantern.sources import linked


def test_a_row_goes_with_all_pages_of_its_address_at_once(spark):
    """So that results, which have many more rows than both sides, take little room."""
    link = lambda x: F.format_string("http://x.example/%d ", x)
    pages = spark.range(60).select("id", F.concat(link(F.col("id") % 3), link(F.col("id") % 4), link(F.lit(9))).alias("html")).repartition(5)
    names = F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.concat("url", F.lit(" "), k.cast("string"))))
    fetched = spark.range(4).select(F.trim(link(F.col("id"))).alias("url")).withColumn("html", names)
    parser = lambda html: F.transform(F.split(html, ","), lambda x: F.struct(x.alias("name")))
    got = [tuple(r) for r in linked.rows(pages, fetched, "id", r"http://x\.example/\d", parser).select("id", "url", "name").collect()]
    want = {(i, f"http://x.example/{k}", f"http://x.example/{k} {n}") for i in range(60) for k in {i % 3, i % 4} for n in range(30)}
    assert len(got) == len(want) and set(got) == want
    runs = [(name, [r[0] for r in some]) for name, some in groupby(got, lambda r: r[2])]
    assert len(runs) == len({name for name, _ in runs}) == 120
