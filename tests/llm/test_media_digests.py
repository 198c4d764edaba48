import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from lantern.llm import gif, queries

KIND = "doc_id long, text string"


def plain(text):
    data = (text or "").encode()
    payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
    bins = [0] * 64
    for b in payload:
        bins[(b >> 6) << 4 | ((b >> 3) & 3) << 2 | b & 3] += 1
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), ",".join(map(str, bins))


def columns(r):
    return r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]


def test_digests_of_odd_texts(spark):
    texts = ["", None, "a", "é" * 63, "x" * 64, "x" * 65, "long " * 40_000, "日本🎉", "".join(map(chr, range(32, 1000))), "same", "same"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "same")], KIND).withColumns({"media": F.lit("x"), "n_bytes": F.lit(1)})
    rows = gif.media_digests(gif.encode_media(docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert columns(r) == plain(texts[r["doc_id"]] if r["doc_id"] is not None else "same")
        media = gif.payload_gif((texts[r["doc_id"]] or "").encode()) if r["doc_id"] is not None else gif.payload_gif(b"same")
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        frames = -(-r["payload_bytes"] // (64 * gif.ROWS))
        assert (r["n_frames"], r["duration_ms"]) == (frames, 10 * gif.DELAY * frames)
    assert gif.media_digests(gif.encode_media(docs.limit(0))).count() == 0


def test_query_equals_plain_digests(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op3_gif_media(spark, path).collect()
    assert {r["doc_id"]: columns(r) for r in rows} == {k: plain(t) for k, t in texts.items()}


def test_frames_of_a_payload(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000)], KIND)
    media = gif.encode_media(docs)
    rows = gif.frames(media).orderBy("frame").collect()
    assert [r["start_ms"] for r in rows] == [0, 100] and [r["height"] for r in rows] == [1024, 1024]
    assert np.count_nonzero(rows[0]["histogram"]) >= 4 and sum(rows[0]["histogram"]) == 64 * 1024


def test_null_and_broken_media(spark):
    media = spark.createDataFrame([(1, None, None), (2, 0, b""), (3, 0, b"no gif"), (4, 0, b"GIF89a\xff\xff\xff\xff\xf7\0\0")], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in gif.media_digests(media).collect()}
    assert rows[1]["payload_bytes"] is None and rows[1]["feature"] is None
    assert [rows[k]["payload_bytes"] for k in (2, 3, 4)] == [0, 0, 0] and list(gif.read_gif(b"GIF89a\xff\xff\xff\xff\xf7\0\0")) == []
