"""The best match by bounds against all pairs, and similarities against plain ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from lantern.functions import similarity, text
from lantern.operators import matching
from lantern.sources import catalog, linked, pages


def plain_winkler(a, b):
    if a == b:
        return 1.0
    reach, free, mine = max(len(a), len(b)) // 2 - 1, list(b), []
    taken = [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and free[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs, m = [y for y, t in zip(b, taken) if t], len(mine)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, theirs)) / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def test_jaro_winkler_of_many_pairs(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdş 🙂") for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 13, 40])))
    pairs = [(word(), word()) for _ in range(3000)] + [("x" * 3000, "x" * 2999 + "y"), ("", ""), ("a", "")]
    want = [plain_winkler(a, b) for a, b in pairs]
    assert np.allclose(similarity.jaro_winkler_of(np.array([a for a, _ in pairs[:3000]], object), np.array([b for _, b in pairs[:3000]], object)), want[:3000])
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in df.withColumn("s", similarity.jaro_winkler(F.col("a"), F.col("b"))).orderBy("i").collect()]
    assert np.allclose(got, want)


def plain_best(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    s, t = set(a.split()), set(b.split())
    common, left, right = (" ".join(sorted(x)) for x in (s & t, s, t))
    return max(1 - row[-1] / max(len(a), len(b)), plain_winkler(a, b), plain_winkler(common, left), plain_winkler(common, right), plain_winkler(left, right))


def test_best_match_equals_all_pairs(spark):
    draw = random.Random(7)
    words = ["AKSU", "GUNES", "MERKEZ", "CELIK", "KONAK", "YENI", "SIFA", "A", "NUR", "NURI"]

    def name():
        made = list(" ".join(draw.sample(words, draw.randint(1, 3))))
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(made))
            made[at : at + draw.randint(0, 1)] = draw.choice("AEKNS")
        return "".join(made)

    phones = [None, "", "02322345678", "0232 234 56 78", "05322345678", "123"]
    places = [None, "", "Bornova", "Bornovaa", "Buca", "Konak İlçesi", "Konk"]
    rows = [(draw.randint(0, 2), i, draw.choice([name(), name(), None, ""]), draw.choice(places), draw.choice(phones)) for i in range(120)] + [(9, 500, "AKSU", None, None)]
    cands = [(draw.randint(0, 2), i, draw.choice([name(), name(), name(), None]), draw.choice(places), draw.choice(phones)) for i in range(150)]
    r = spark.createDataFrame(rows, "block int, row_id int, name string, district string, phone string")
    c = spark.createDataFrame(cands, "block int, ord int, canonical_name string, district_name string, phone string")
    norm = lambda df, n, d: {(x[0], x[1]): x for x in df.select("block", df.columns[1], text.pharmacy_name(F.col(n)), text.district_name(F.col(d)), text.digits(F.col("phone")), n).collect()}
    mine, theirs = norm(r, "name", "district"), norm(c, "canonical_name", "district_name")
    want = {}
    for (block, i), (_, _, n, d, p, _) in mine.items():
        best = (0.0, 0, None)
        for (other, ord_), (_, _, cn, cd, cp, raw) in theirs.items():
            if other == block:
                phone = (1.0 if p == cp else 0.8 if min(len(p), len(cp)) >= 7 and p[-7:] == cp[-7:] else 0.0) if p and cp else 0.0
                place = plain_winkler(d, cd) if d and cd else 0.0
                best = max(best, (round(0.6 * plain_best(n, cn) + 0.25 * phone + 0.15 * place, 9), -ord_, raw), key=lambda x: x[:2])
        want[i] = best
    checked = []
    got = matching.best_match(r, c, ["block"], checked).collect()
    assert len(got) == len(rows)
    for x in got:
        score, _, raw = want[x["row_id"]]
        assert abs(x["confidence"] - score) < 6e-4, (x, score)
        assert (x["match"], x["match_type"] != "no_match") == ((raw, True) if score >= 0.5 else (None, False)), (x, want[x["row_id"]])
    assert checked[0].count() < 0.5 * len(rows) * len(cands) / 3


def test_alias_of_the_slug_where_that_of_the_name_leads_nowhere(spark):
    rows = spark.createDataFrame([(1, 1, "Il-Merkezi"), (2, 1, "Gölbaşı Belediyesi"), (3, 1, "Belediye Merkezi")], "row_id int, block int, raw string")
    d = spark.createDataFrame([(1, 0, 7, "Centrum", "merkez"), (1, 1, 8, "Golbasi Town", "golbasi")], "block int, ord int, id int, name string, slug string")
    got = {r["row_id"]: (r["district_id"], r["level"]) for r in matching.resolve_districts(rows, d, "block").collect()}
    assert got[2] == (8, "alias") and got[3][1] in ("alias", "fallback")


def test_linked_pages(spark):
    start = spark.createDataFrame([(1, "x https://a.s.example/list/1 https://a.s.example/list/2 https://a.s.example/list/1"), (2, "none"), (3, None), (4, "https://a.s.example/list/9")], "id int, html string")
    link = '<a href="https://maps.google.com/?q=1" style="font-weight:bold">{}</a>'
    fetched = spark.createDataFrame([("https://a.s.example/list/1", link.format("AKSU") + link.format("GECE : KONAK")), ("https://a.s.example/list/2", None)], "url string, html string")
    pattern = r"https?://[a-z]+\.s\.example/list/\d+"
    assert sorted((r["id"], r["name"]) for r in linked.rows(start, fetched, "id", pattern, pages.map_links).collect()) == [(1, "AKSU"), (1, "KONAK")]
    assert sorted(map(tuple, linked.errors(start, fetched, "id", pattern).collect())) == [(2, "no_links", 0, 0), (3, "no_links", 0, 0), (4, "missing_pages", 1, 1)]
    base = spark.createDataFrame([(1, "https://h.example/a/b/c?x=1", "<a href='../d'></a><img src=\"e.png\"><a href='../d'>")], "id int, url string, html string")
    assert sorted(r["url"] for r in linked.references(base.withColumnRenamed("url", "base"), "id", "base").collect()) == ["https://h.example/a/b/e.png", "https://h.example/a/d"]


def test_dots_in_addresses(spark):
    cases = [("", "https://a.example/x/y?q"), ("../z", "https://a.example/z"), ("../../../z/./", "https://a.example/z/"), ("..", "https://a.example/"), ("/a/b/../c?d=../e#..", "https://a.example/a/c?d=../e#.."), ("?n=1", "https://a.example/x/y?n=1"), (".", "https://a.example/x/")]
    df = spark.createDataFrame(cases, "a string, want string").withColumn("got", catalog.resolved(F.lit("https://a.example/x/y?q"), F.col("a")))
    assert [(r["a"], r["got"]) for r in df.collect()] == cases


def test_rows_whose_best_is_known_by_keys_meet_no_bounds(spark, monkeypatch):
    """Names of one block with a letter more or less or in another place: no pair of a block is bounded."""
    names = [f"CUSTOMER#{k * 7919 % 100_000:05d}" for k in range(400)]
    rows = [(1, k, n.replace("TOM", "TM"), "Buca" if k % 3 else "Konak", None) for k, n in enumerate(names)]
    cands = [(1, i * 400 + k, n, "Buca" if k % 3 else "Konak", None) for i in range(2) for k, n in enumerate(names)]
    r = spark.createDataFrame(rows, "block int, row_id int, name string, district string, phone string")
    c = spark.createDataFrame(cands, "block int, ord int, canonical_name string, district_name string, phone string")

    def never(*_):
        raise AssertionError("all pairs of a block are bounded")

    monkeypatch.setattr(matching, "_bounded", never)
    checked = []
    got = {x["row_id"]: (x["match"], x["confidence"]) for x in matching.best_match(r, c, ["block"], checked).collect()}
    assert checked[0].count() < 400 * 40
    for k in range(0, 400, 20):
        want = max((0.6 * plain_best(rows[k][2], n) + 0.15 * (1.0 if rows[k][3] == cands[j][3] else plain_winkler(rows[k][3].lower(), cands[j][3].lower())), -j) for j, n in enumerate(names))
        assert got[k] == (names[-want[1]], round(want[0], 3))


def test_very_common_words_and_phones_meet_all_of_their_block(spark, monkeypatch):
    monkeypatch.setattr(matching, "COMMON", 3)
    test_best_match_equals_all_pairs(spark)
