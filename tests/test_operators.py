import datetime as dt

from pyspark.sql import functions as F

from lantern.operators import matching, upsert
from lantern.sources import pages
from lantern.streaming import state


def test_name_difference(spark):
    ours = spark.createDataFrame([(1, 1, "AKSU ECZ"), (1, 2, "KONAKK")], "block int, ord int, name string")
    official = spark.createDataFrame([(1, 1, "AKSU ECZANESI"), (1, 2, "KONAK"), (1, 3, "YENI")], "block int, ord int, name string")
    diff = matching.name_difference(ours, official, "block")
    rows = sorted((r["kind"], r["official"], r["ours"], r["distance"]) for r in diff.collect())
    assert rows == [("matched", "AKSU ECZANESI", "AKSU ECZ", 0), ("mismatch", "KONAK", "KONAKK", 1), ("missing", "YENI", None, None)]
    assert matching.difference_severity(diff, "block").first()["severity"] == "high"


def test_greedy_pairs_take_the_nearest_first(spark):
    near = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 1), (1, "b", "x", 1), (1, "c", "x", 0)], "g int, a string, b string, distance int")
    assert sorted((r["a"], r["b"]) for r in matching.greedy_pairs("g", "a", "b", near).collect()) == [("a", "y"), ("c", "x")]


def test_district_levels(spark):
    names = [(1, "Bornova", "bornova"), (2, "Buca", "buca"), (3, "Konak", "konak"), (4, "Karşıyaka", "karsiyaka"), (5, "Merkez", "merkez"), (6, "Çiğli", "cigli")]
    districts = spark.createDataFrame([(1, i, i, n, s) for i, n, s in names], "p int, ord int, id int, name string, slug string")
    wanted = {"bornova": (1, "exact"), "Bornova Belediyesi": (1, "normalized"), "Merkez İlçe": (5, "alias"), "Bornovaa": (1, "fuzzy"), "XYZXYZ": (5, "fallback"), "": (5, "fallback")}
    rows = spark.createDataFrame([(i, 1, raw) for i, raw in enumerate(wanted)] + [(99, 2, "Buca")], "row_id int, p int, raw string")
    found = {r["row_id"]: (r["district_id"], r["level"]) for r in matching.resolve_districts(rows, districts, "p").collect()}
    assert found == {**dict(enumerate(wanted.values())), 99: (None, "none")}
    assert {r["level"] for r in matching.resolve_districts(rows.where("row_id = 4"), districts, "p", fallback=False).collect()} == {"none"}


def test_best_match(spark):
    c = [(1, 1, "AKSU", "Bornova", "02322345678"), (1, 2, "GUNES", "Buca", "02323456789")]
    candidates = spark.createDataFrame(c, "p int, ord int, canonical_name string, district_name string, phone string")
    r = [(1, 1, "AKSU ECZANESI", "Bornova", "02322345678"), (1, 2, "Güneş Eczanesi", "Buca", "02323456789"), (1, 3, "XYZXYZXYZ BILINMEYEN", None, None), (2, 4, "AKSU", None, None)]
    rows = spark.createDataFrame(r, "p int, row_id int, name string, district string, phone string")
    found = {x["row_id"]: (x["match"], x["match_type"]) for x in matching.best_match(rows, candidates, ["p"]).collect()}
    assert found == {1: ("AKSU", "exact"), 2: ("GUNES", "exact"), 3: (None, "no_match"), 4: (None, "no_match")}


def test_health(spark):
    t = lambda i: dt.datetime(2024, 1, 1, i)
    runs = {"A": "F", "B": "SFF", "C": "SFFF", "D": "SFFFS"}
    df = spark.createDataFrame([(k, t(i), x == "S") for k, v in runs.items() for i, x in enumerate(v)], "key string, ts timestamp, ok boolean")
    found = {r["key"]: (r["is_healthy"], r["consecutive_failures"]) for r in upsert.failures_in_a_row(df, "key", "ts", F.col("ok")).collect()}
    assert found == {"A": (False, 1), "B": (True, 2), "C": (False, 3), "D": (True, 0)}


def test_health_stream(spark, tmp_path):
    t = lambda i: dt.datetime(2024, 1, 1, i)
    schema = "key long, ts timestamp, ok boolean"
    spark.createDataFrame([(1, t(0), False), (2, t(0), True), (2, t(1), False), (2, t(2), False), (2, t(3), False)], schema).write.parquet(str(tmp_path / "in"))
    stream = state.health_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("health").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r["key"], r["consecutive_failures"], r["is_healthy"]) for r in spark.table("health").collect()) == [(1, 1, False), (2, 3, False)]


def test_rate_limit_windows_begin_at_the_first_request(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, s)) for s in range(21)] + [(1, dt.datetime(2024, 1, 1, 0, 1, 0)), (2, dt.datetime(2024, 1, 1))]
    out = state.rate_limit(spark.createDataFrame(rows, "key long, ts timestamp")).orderBy("key", "ts").collect()
    assert [r["allowed"] for r in out] == [True] * 20 + [False, True, True]


def test_upsert_keeps_what_is_empty(spark):
    kind = "district_id int, normalized_name string, canonical_name string, address string, phone string, lat double, lng double"
    old = spark.createDataFrame([(1, "A", "A", "X", "1", None, 2.0, True)], kind + ", is_active boolean")
    new = spark.createDataFrame([(1, "A", "a", "", None, 41.0, None, 1), (1, "B", "b", "Y", "2", None, None, 2)], kind + ", ord int")
    rows = sorted(tuple(r) for r in upsert.upsert_places(old, new).collect())
    assert rows == [(1, "A", "a", "X", "1", 41.0, 2.0, True), (1, "B", "b", "Y", "2", None, None, True)]


def test_parsers_and_dispatch(spark):
    html = [
        (1, "<table><tr><th>Eczane</th><th>Telefon</th></tr><tr><td>AKSU ECZANESI</td><td>Tel: 0232 1</td></tr><tr><td>KONAK</td><td>2</td></tr></table>"),
        (2, '<div data-name="G&uuml;l" data-district="Buca"></div><div data-name="Aksu" data-district="Konak"></div>'),
        (3, ""),
        (4, "<p>nothing</p>"),
        (5, '<h2>Bornova</h2><h4>Ay Eczanesi</h4><p>1. Sokak<br><a href="tel:0232">ara</a></p>'),
    ]
    out = pages.dispatch(spark.createDataFrame(html, "id int, html string"))
    found = {r["id"]: (r["strategy"], r["parser"], [(x["name"], x["district"], x["phone"]) for x in r["rows"]]) for r in out.collect()}
    assert found[1] == ("auto", "table_auto_v1", [("AKSU ECZANESI", "", "0232 1"), ("KONAK", "", "2")])
    assert found[2][:2] == ("auto", "inline_box_v1") and found[2][2][-1] == ("Aksu", "Konak", "")
    assert found[3][0] == "empty_html" and found[4][0] == "no_match"
    assert found[5] == ("no_match", None, [])  # cards under headings are parsed where they are asked for


def test_json_rows(spark):
    payloads = ['{"data": [{"eczane": "Aksu", "ilce": "Buca", "tel": "0232"}]}', '[{"name": "", "ad": "Aksu"}]', "broken", None]
    out = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string").select("i", pages.json_rows(F.col("p")).alias("r")).orderBy("i").collect()
    assert [[(x["name"], x["district"], x["phone"]) for x in r["r"]] for r in out] == [[("Aksu", "Buca", "0232")], [], [], []]
