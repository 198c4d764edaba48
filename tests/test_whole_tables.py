from lantern import queries

SF = "/root/testdata/sf0.001"


def test_dispatch_reads_every_customer(spark):
    rows = queries.QUERIES["prs0_dispatch"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_set_operations_take_every_nation(spark):
    nations = {r["c_nationkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    assert len({r["c_nationkey"] for r in queries.QUERIES["set2_intersect_whole"](spark, SF).collect()}) > 1
    assert {r["c_nationkey"] for r in queries.QUERIES["ag23_fingerprint_sums"](spark, SF).collect()} == nations
    by_nation = queries.QUERIES["set1_except"](spark, SF).collect()
    assert queries.QUERIES["set1_except_whole"](spark, SF).count() == len(by_nation) and len({r["c_nationkey"] for r in by_nation}) > 1
