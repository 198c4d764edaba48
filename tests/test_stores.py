"""Tables that change in versions, state that goes, and pairs that wait for each other in long chains."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lantern.operators import matching, stores, sync
from lantern.streaming import state


def over(old, batch):
    return old.join(batch.select("k", F.col("v").alias("n")), "k", "full_outer").select("k", F.coalesce("n", "v").alias("v"))


def test_a_merge_writes_the_named_buckets_only(spark, tmp_path):
    t = stores.KeyedTable(spark, str(tmp_path / "t"), ["k"], 8)
    t.create(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    before = t.manifest()["buckets"]
    assert t.merge(spark.createDataFrame([(3, "new"), (500, "new")], "k long, v string"), over) == 2
    after = t.manifest()["buckets"]
    assert 1 <= sum(before.get(b) != after.get(b) for b in after) <= 2
    rows = {r["k"]: r["v"] for r in t.read().collect()}
    assert rows == {k: "old" for k in range(100)} | {3: "new", 500: "new"}
    assert {r["v"] for r in t.read(version=1).collect()} == {"old"}
    assert t.merge(spark.createDataFrame([], "k long, v string"), over) == 2


def test_a_slower_writer_goes_over_the_faster_ones_version(spark, tmp_path):
    t = stores.KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    t.create(spark.createDataFrame([(1, "a")], "k long, v string"))
    other, again = stores.KeyedTable(spark, str(tmp_path / "t"), ["k"], 4), []

    def slow(old, batch):
        if not again:
            again.append(other.merge(spark.createDataFrame([(1, "faster"), (2, "faster")], "k long, v string"), over))
        return over(old, batch)

    assert t.merge(spark.createDataFrame([(1, "slower")], "k long, v string"), slow) == 3
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: "slower", 2: "faster"}
    with pytest.raises(stores.Conflict):
        t.commit({}, 1)
    assert t.version() == 3


def test_tables_that_change_together(spark, tmp_path):
    s = stores.TableSet(spark, str(tmp_path / "s"))
    assert s.write({"a": spark.range(3), "b": spark.range(4)}) == 1
    with pytest.raises(stores.Conflict):
        s.write({"a": spark.range(9), "b": spark.range(9)}, base=0)
    assert (s.read("a").count(), s.read("b").count()) == (3, 4)


def test_sync_makes_sources_before_their_endpoints(spark):
    catalog = spark.createDataFrame([("izmir", "oda", "chamber_html", "u", "https://x", "html", "p"), ("yok", "oda", "x", "u", "https://y", "html", "p")], "code string, source_name string, official_type string, base_url string, official_url string, format string, parser_key string")
    provinces = spark.createDataFrame([(35, "izmir")], "id long, slug string")
    sources = spark.createDataFrame([], "id long, province_id long, name string, type string, authority_weight int, base_url string, enabled boolean")
    endpoints = spark.createDataFrame([], "id long, source_id long, endpoint_url string, format string, parser_key string, is_primary boolean, poll_cron string, enabled boolean")
    s, e, summary = sync.synced(catalog, provinces, sources, endpoints)
    assert [tuple(r) for r in s.collect()] == [(1, 35, "oda", "pharmacists_chamber", 90, "u", True)]
    assert [tuple(r) for r in e.collect()] == [(1, 1, "https://x", "html", "p", True, "*/30 * * * *", True)]
    assert summary.first().asDict() == {"target_count": 2, "synced_count": 1, "created_sources": 1, "updated_sources": 0, "created_endpoints": 1, "updated_endpoints": 0, "missing_provinces": "yok", "demoted_primary_endpoints": 0}
    again = sync.synced(catalog, provinces, s, e)
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, s.collect())) and again[2].first()["updated_endpoints"] == 1


@pytest.mark.parametrize("kind", ["rate", "health"])
def test_state_of_silent_keys_goes(spark, tmp_path, kind):
    at = lambda day, s=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=s)
    schema, batches = "key long, ts timestamp, ok boolean", [[(k, at(0, k), True) for k in range(20)], [(99, at(60), True)], [(99, at(61), True), (1, at(0), True)], [(99, at(62), True)]]
    (tmp_path / "in").mkdir()
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = state.health_stream(df) if kind == "health" else state.rate_limit_stream(df.drop("ok"))
    q = stream.writeStream.format("memory").queryName(f"timed_{kind}").outputMode("update" if kind == "health" else "append").option("checkpointLocation", str(tmp_path / "cp")).start()
    sizes = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    assert sizes[0] == 20 and sizes[-1] <= 1
    assert spark.table(f"timed_{kind}").where("key = 1").count() == 1  # the late row is left out


def test_long_chains_end_in_few_rounds(spark, monkeypatch):
    n, tables, kept = 10_000, [], matching.kept
    monkeypatch.setattr(matching, "kept", lambda df: tables.append(1) or kept(df))
    near = spark.range(n).select(F.lit(1).alias("block"), F.format_string("a%06d", "id").alias("a"), F.format_string("b%06d", "id").alias("b"), F.lit(1).alias("distance"))
    near = near.unionByName(near.select("block", F.format_string("a%06d", F.substring("a", 2, 6).cast("int") + 1).alias("a"), "b", "distance"))
    got = matching.greedy_pairs("block", "a", "b", near)
    assert got.where("substring(a, 2) = substring(b, 2)").count() == got.count() == n
    assert len(tables) < 60


def test_components_over_the_size_of_a_task_go_on_by_rounds(spark):
    near = [(1, f"a{i + j}", f"b{i}", 1) for i in range(6) for j in (0, 1)] + [(2, "x", "y", 0)]
    got = matching.greedy_pairs("block", "a", "b", spark.createDataFrame(near, "block int, a string, b string, distance int"), rounds=1, most=3)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted([(f"a{i}", f"b{i}") for i in range(6)] + [("x", "y")])


def test_intermediate_tables_can_be_dropped(spark):
    from lantern.operators import tables

    tables.drop_kept(spark)
    kept = tables.kept(spark.range(3))
    assert kept.count() == 3 and tables.drop_kept(spark) == 1 and tables.drop_kept(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist|FILE_NOT_EXIST|FAILED_READ_FILE"):
        spark.read.parquet(kept.inputFiles()[0]).count()
