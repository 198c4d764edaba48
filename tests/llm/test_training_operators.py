import base64
import os
import struct

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lantern.llm import ann, bpe, components, gif, html, lm, mixing, neardup, quality, queries, shards, toxicity, weak

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", None) for i, t in enumerate(texts)], DOCS)


def words(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 500, n))


# byte-level BPE
@pytest.fixture(scope="module")
def coder():
    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.encoder(queries.RANKS, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(coder):
    rng = np.random.default_rng(3)
    texts = ["", " ", " a", "a ", "a  b", "\n \n a\n b", "it's  'S", "日本語 テキスト🎉", "a" * 9000, "ab" * 5000 + "é" * 3000, "<|endoftext|>", "x y  z", "1234567890" * 20]
    texts += ["".join(map(chr, rng.choice([32, 10, 39, 97, 101, 115, 116, 233, 12354, 128512, 48, 45], 300))) for _ in range(60)]
    for t in texts:
        assert coder[0].encode(t) == coder[1].encode_ordinary(t)
        assert "".join(coder[0].decode(coder[0].encode(t))) == t


def test_decoding_waits_for_whole_characters():
    s = bpe.Utf8Stream()
    data = "aé日🎉".encode()
    assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.end() == "aé日🎉"


def test_bpe_digests(spark, coder):
    docs = docs_of(spark, ["hello world", None, ""]).withColumn("ids", F.lit(1))
    rows = {r["doc_id"]: r["n_tokens"] for r in bpe.token_digests(docs, queries.RANKS, public_tokenizers.PATTERN).collect()}
    assert rows == {0: len(coder[1].encode_ordinary("hello world")), 1: 0, 2: 0}
    back = bpe.decode_documents(bpe.encode_documents(docs, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == [(0, "hello world"), (1, ""), (2, "")]


# pages
def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
    <div class="cookie-notice">We use cookies for everything that you do here.</div><div id="content"><article><header><h1>Head &amp; line</h1></header>
    <p>First   paragraph of the story with <b>bold</b> and <a href=y>a link</a>.<br>Second line.<p>Unclosed paragraph here &eacute;t more text to read.
    <ul><li>one item<li>two items</ul><div class="ad">Buy this now, it is very cheap today only</div><form><input>Sign up</form><script>var x = "</p>";</script></article>
    <section id="comments"><p>A reader says a long comment about this story here.</p></section></div><aside>Other stories</aside><footer>&copy; 2024</footer></body></html>"""
    wanted = ["Head & line", "First paragraph of the story with bold and a link. Second line.", "Unclosed paragraph here ét more text to read.", "one item", "two items"]
    assert html.main_text(page) == "\n\n".join(wanted)
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain text") == "plain text"
    assert html.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert html.main_text("<p>a < b and \"c <p class=\"x>open") != ""


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Text of a page</p>", 5), (2, None, None, 6), (2, None, None, 6)], "page_id int, url string, html string, text int")
    assert sorted(map(tuple, html.extract_pages(pages).collect()), key=str) == [(1, "u", "Text of a page", 14), (2, None, "", 0), (2, None, "", 0)]


# media
def test_gif_stores_bytes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 64, 65, 5000, 70_000, 140_000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"abcab" * (n // 5)):
            payload, histogram, *_ = gif.stored_payload(gif.payload_gif(data))
            assert payload.rstrip(b"\0") == data.rstrip(b"\0") and len(payload) % 64 == 0 and len(payload) >= 64
            assert histogram.sum() == len(payload)


def made_gif(*frames, palette=b"\xff\0\0\0\xff\0\0\0\xff\xff\xff\xff"):
    """Frames of (x, y, w, h, samples, disposal, transparent, interlaced) on a screen of 2 x 8."""
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 8, 0x81, 0, 0) + palette
    for x, y, w, h, samples, disposal, clear, interlaced in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + struct.pack("<H", 5) + bytes([clear or 0, 0])
        data = gif.lzw_encode(bytes(samples), 2)
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if interlaced else 0) + b"\x02" + bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


def test_gif_rules():
    first = [1, 1] * 8
    a, b, c, d = gif.read_gif(made_gif((0, 0, 2, 8, first, 1, None, False), (0, 0, 2, 1, [2, 3], 3, 3, False), (1, 1, 1, 1, [2], 2, None, False), (0, 0, 2, 8, [i // 2 % 4 for i in range(16)], 0, None, True)))
    green, blue, red = [0, 255, 0], [0, 0, 255], [255, 0, 0]
    assert a.canvas[0].tolist() == [green, green] and b.canvas[0].tolist() == [blue, green]  # sample 3 is transparent
    assert c.canvas[0].tolist() == [green, green] and c.canvas[1].tolist() == [green, blue]  # the frame before was undone
    # sample i // 2 % 4 is row i of the file; the rows of an interlaced picture come as 0, 4, 2, 6, 1, 3, 5, 7
    white = [255, 255, 255]
    assert [r[0].tolist() for r in d.canvas] == [red, red, blue, green, green, blue, white, white]
    assert [f.start_ms for f in (a, b, c, d)] == [0, 50, 100, 150]
    assert a.histogram().sum() == 16


def test_broken_gifs_give_the_frames_before(spark):
    good = gif.payload_gif(b"x" * 100)
    media = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, b"no gif at all"), (5, good[:400])], "doc_id long, media binary")
    rows = gif.frames(media).collect()
    assert [(r["doc_id"], r["frame"], r["width"], r["height"]) for r in rows if r["doc_id"] < 5] == [(1, 0, 64, 2)]


def test_long_streams_without_clear_codes():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 4, 60_000, dtype=np.uint8).tobytes()
    codes, table, word = [256], {}, -1
    for x in data:  # the table stays full instead of being cleared
        if word >= 0 and (code := table.get(word << 8 | x)) is not None:
            word = code
            continue
        if word >= 0:
            codes.append(word)
            if len(table) < 4096 - 258:
                table[word << 8 | x] = 258 + len(table)
        word = x
    codes += [word, 257]
    bits = gif._packed(np.array(codes, np.uint16), 8)
    assert gif.lzw_decode(bits, 8, len(data)) == data


# nearest neighbours
def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 20))
    v[50:55] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 20), (702, [float("nan")] * 20), (703, [None] * 20), (None, [1.0] * 20), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries_ = df.where("vec_id % 20 = 0")
    found = ann.search(df, queries_, k=10, block=64).collect()
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and q not in {r["vec_id"] for r in mine}
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:10]
        hits += len({r["vec_id"] for r in mine} & set(best.tolist()))
        assert all(abs(r["score"] - v[r["vec_id"]] @ v[q]) < 1e-9 for r in mine)
        order = [(-r["score"], r["vec_id"]) for r in mine]
        assert order == sorted(order)
    assert hits >= 0.9 * 300
    assert ann.search(df.where("vec_id > 699"), queries_).count() == 0


def test_hadamard_is_orthonormal():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


# near copies
def brute(texts):
    sets = [set(neardup.shingles(t).tolist()) for t in texts]
    links = {}
    for i, a in enumerate(sets):
        for b in {frozenset(x) for x in sets}:
            if b and a and b != a and len(a & b) >= 0.8 * len(a | b):
                links.setdefault(i, set()).add(b)
    return {i: len(links.get(i, ())) for i in range(len(texts))}


def test_similarity_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(40):
        t = words(rng, 80)
        texts += [t] * int(rng.integers(1, 3))
        for _ in range(int(rng.integers(0, 6))):
            w = t.split()
            w[int(rng.integers(0, 80))] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(w))
    texts += ["", None, " \n", "two words", "two  words", "two word"]
    for block in (neardup.BLOCK, 2000):
        rows = {r["doc_id"]: r for r in neardup.similarity_join(docs_of(spark, texts).withColumn("rep", F.lit(0)), block=block).collect()}
        assert {i: r["n_links"] for i, r in rows.items()} == brute(texts)
    n = len(texts)
    assert {rows[i]["class_id"] for i in (n - 6, n - 5, n - 4)} == {n - 6} and rows[n - 2]["class_id"] == n - 3 and rows[n - 1]["class_id"] == n - 1
    assert neardup.one_of_each(docs_of(spark, texts)).count() == len({r["class_id"] for r in rows.values()})
    assert neardup.similarity_join(docs_of(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 8), (7, 7), (None, 1)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(edges).collect()} == {**dict.fromkeys(range(1, 7), 1), 8: 8, 9: 8}


# weak supervision
def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((4000, 4)) < right, y[:, None], ~y[:, None]).astype(int)
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    start = np.where(patterns.sum(1, keepdims=True) > 2, [[0.2, 0.8]], [[0.8, 0.2]])
    model = weak.fit_label_model(patterns, np.bincount(at.ravel()), start, silence=False)
    assert np.abs(model.accuracies(patterns, np.bincount(at.ravel()), 1) - right).max() < 0.06
    assert ((model.posterior(votes)[:, 1] > 0.5) == y).mean() > 0.94


def test_toxicity_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)
    odd = docs_of(spark, [None, "", "you idiot"]).withColumn("toxic", F.lit(1))
    assert [r["predicted"] for r in toxicity.toxicity(odd, labels.limit(0)).orderBy("doc_id").collect()] == [0, 0, 1]


def test_quality_on_labelled_rows(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs).join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").collect()
    assert sum(r["predicted"] == r["good"] for r in rows) >= 0.97 * len(rows)
    assert quality.quality(docs_of(spark, [])).count() == 0
    assert quality.quality(docs_of(spark, [None, "", "a"])).count() == 3


# language model, mixing
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.sql(queries.ORACLE_SQL[name])
    order = [list(found.columns).index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in found.fetchall())


def test_scores_of_odd_texts(spark):
    rows = {r["doc_id"]: r for r in lm.score(docs_of(spark, ["a b a b", "a", "", None, "  "]), least=2).collect()}
    assert rows[1]["log_score"] == pytest.approx(np.log(3 / 5)) and rows[2]["n_tokens"] == rows[3]["n_tokens"] == rows[4]["n_tokens"] == 0
    # a b twice: c(ab) = 2; b a once, so it backs off
    assert rows[0]["log_score"] == pytest.approx(np.log(3 / 5) + 2 * np.log(2 / 3) + np.log(0.4 * 3 / 5))
    assert rows[2]["mean_log_score"] is None and lm.score(docs_of(spark, [])).count() == 0


def test_budgets_go_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "1", 100), ("b", "x", "1", 5)]
    given = mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), 100, 1)
    # b can give 5 of its 50; a gets 95: 47 for x, where source 1 gives 10 and source 2 the rest
    assert {(r["domain"], r["lang"], r["source"]): r["given"] for r in given.collect()} == {("a", "x", "1"): 10, ("a", "x", "2"): 37, ("a", "y", "1"): 47, ("b", "x", "1"): 5}


def test_mix_of_odd_tables(spark):
    docs = docs_of(spark, ["a b c", None, "", "a"]).withColumn("tokens", F.lit("x"))
    assert mixing.mix(docs.limit(0), F.lit("d"), 1.0, 2).count() == 0
    assert sum(r["tokens"] * r["copies"] for r in mixing.mix(docs, F.lit(None), 1.0, 2).collect()) <= 4


# shards
def test_store(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, smallest=1 << 10, fanout=3)
    df = spark.range(3000).withColumn("text", F.md5(F.col("id").cast("string")))
    for k in range(7):
        store.append(df.where(f"id % 7 = {k}").repartition(2), k)
    assert store.version() == 7 and len(store.shards()) == 14
    before = store.shards()
    with pytest.raises(shards.Conflict):
        store.commit(before, 3)
    store.compact()
    assert len(store.shards()) < 6 and store.read().select("id").distinct().count() == store.read().count() == 3000
    assert store.plan(store.shards()) == []


def test_sharded(spark, tmp_path):
    rows = shards.sharded(docs_of(spark, ["a", None, "", "é"] * 3).unionByName(docs_of(spark, ["a"])), f"file://{tmp_path}/s").collect()
    assert len(rows) == 13 and {r["n_bytes"] for r in rows} == {0, 1, 2, None}
    assert shards.sharded(docs_of(spark, []), f"file://{tmp_path}/e").count() == 0
