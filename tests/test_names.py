import random

import pytest
from pyspark.sql import functions as F

from lantern.functions import numbers, similarity, text
from lantern.operators import logs, matching, serving
from lantern.sources import catalog, pages


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def most(n):
    return 1 if n <= 6 else 2 if n <= 10 else 3 if n <= 16 else 4 if n <= 22 else 5


@pytest.fixture(scope="module")
def names():
    rng, made = random.Random(4), set()
    for _ in range(40):
        base = "".join(rng.choice("abcd e") for _ in range(rng.choice([1, 2, 3, 6, 7, 10, 11, 16, 17, 22, 23, 30])))
        for _ in range(3):
            letters = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(letters) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    letters.insert(at, rng.choice("abcdx"))
                elif letters and kind == 1:
                    letters.pop(at % len(letters))
                elif letters:
                    letters[at % len(letters)] = rng.choice("abcdx")
            made.add("".join(letters))
    made.discard("")
    return sorted(made)


@pytest.mark.parametrize("fixed", [None, 0, 2])
def test_near_names_are_all_pairs_within_the_limit(spark, names, fixed):
    left, right = names[::2], names[1::2] + names[:5]
    a = spark.createDataFrame([(k % 2, n) for n in left for k in (0, 1)], "block int, a string").distinct()
    b = spark.createDataFrame([(0, n) for n in right], "block int, b string").distinct()
    limit = (lambda n: F.lit(fixed)) if fixed is not None else numbers.distance_for
    found = {(r["a"], r["b"]): r["distance"] for r in matching.near_names(a, b, "block", limit).collect()}
    wanted = {(x, y): d for x in left for y in right if (d := edits(x, y)) <= (fixed if fixed is not None else most(min(len(x), len(y))))}
    assert found == wanted


def test_greedy_pairs_equal_plain_ones(spark):
    rng = random.Random(2)
    near = sorted({(rng.randint(0, 2), f"a{rng.randint(0, 9)}", f"b{rng.randint(0, 9)}") for _ in range(120)})
    near = [(*n, rng.randint(0, 3)) for n in near]
    wanted, used = [], set()
    for block, a, b, d in sorted(near, key=lambda n: (n[0], n[3], n[1], n[2])):
        if (block, a) not in used and (block, b) not in used:
            used |= {(block, a), (block, b)}
            wanted.append((block, a, b, d))
    found = matching.greedy_pairs("block", "a", "b", spark.createDataFrame(near, "block int, a string, b string, distance int"))
    assert sorted((r["block"], r["a"], r["b"], r["distance"]) for r in found.collect()) == sorted(wanted)


def test_jaro_winkler_of_known_pairs(spark):
    pairs = [("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("DWAYNE", "DUANE", 0.84), ("", "", 1.0), ("a", "", 0.0), ("abc", "abc", 1.0), ("abc", "xyz", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, s double").withColumn("found", similarity.jaro_winkler(F.col("a"), F.col("b")))
    assert [round(r["found"], 4) for r in df.collect()] == [p[2] for p in pairs]


def test_addresses_that_must_not_be_fetched(spark):
    cases = {"http://10.example.com/": "ok", "http://localhost./": "blocked_host", "http://LOCALHOST": "blocked_host", "https://169.254.169.254/x": "blocked_host", "http://10.1.2.3": "private_ip", "http://[::1]/": "private_ip", "http://2130706433/": "private_ip", "http://user:p@127.0.0.1:80/": "private_ip", "http:/\\localhost/": "blocked_host", "file:///etc": "protocol", "x": "invalid", "http://a.local.": "tld", "http://8.8.8.8": "ok"}
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string").select("u", text.url_fault(F.col("u")).alias("f"))
    assert {r["u"]: r["f"] for r in df.collect()} == {**cases, None: "invalid"}


def test_errors_that_may_pass(spark):
    cases = {"operation aborted": True, "socket closed": True, "ECONNRESET": False, "ENOTFOUND": False, "Timeout": True, "network down": True, "fetch failed": True, "timed out": True, "404": False}
    df = spark.createDataFrame([(m,) for m in cases], "m string").select("m", text.transient(F.col("m")).alias("t"), text.transient(F.lit("x"), F.lit("AbortError")).alias("n"))
    assert {r["m"]: r["t"] for r in df.collect()} == cases and all(r["n"] for r in df.collect())


def test_tables_with_blank_rows_and_other_headers(spark):
    html = "<table><tr><td>small</td></tr><tr><td>x</td></tr></table><table><tr><td>&nbsp;</td></tr><tr><td>title</td></tr><tr><td>Name</td><td>Mahalle</td><td>GSM</td></tr><tr></tr><tr><td>AKSU ECZ</td><td>Bor</td><td>0232</td></tr></table>"
    rows = spark.createDataFrame([(html,)], "h string").select(pages.tables(F.col("h")).alias("r")).first()["r"]
    assert [(r["name"], r["district"], r["phone"], r["lat"]) for r in rows] == [("AKSU ECZ", "Bor", "0232", None)]


def test_regions_and_catalog(spark):
    found = {r["slug"]: r["near"] for r in catalog.same_region(catalog.provinces(spark).select("slug"), catalog.regions(spark)).collect()}
    assert len(found) == 81 and found["izmir"] == ["manisa", "aydin", "denizli", "mugla", "afyonkarahisar", "kutahya", "usak"]
    assert len(found["ankara"]) == 8 and found["corum"] == found["yozgat"] == []


def test_fallback_lists_and_payloads(spark):
    view, table = (spark.createDataFrame(r, "p string, n int") for r in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert sorted((r["p"], r["n"]) for r in serving.with_fallback(view, table, ["p"]).collect()) == [("a", 1), ("b", 3)]
    cases = {None: "{}", "null": "{}", '{"a":1}': '{"a":1}', "5": '{"value":5}', "[1]": '{"value":[1]}', '"x"': '{"value":"x"}'}
    df = spark.createDataFrame([(c,) for c in cases], "p string").select("p", logs.alert_payload(F.col("p")).alias("o"))
    assert {r["p"]: r["o"] for r in df.collect()} == cases
