import numpy as np
from pyspark.sql import functions as F

from lantern.llm import neardup

KIND = "doc_id long, text string, source string"


def test_prefixes_are_shortened_until_the_recall_is_reached():
    assert neardup.stop_depth([0] * 9) == 4 and neardup.stop_depth([0] * 9, recall=0.9) == 8
    assert neardup.expected(4) > 0.999 > neardup.expected(5)
    near = [0, 0, 0, 0, 0, 0, 0, 5, 100_000]  # nearly all pairs of the corpus share eight values
    assert neardup.stop_depth(near) == 8
    far = [0, 0, 0, 300, 0, 0, 0, 0, 50_000]  # a part shares three values only
    assert neardup.stop_depth(far) == 3
    assert neardup.stop_depth([10, 0, 0]) == 1


def test_sample_measures_the_depth_of_its_pairs():
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 900, 100)]
    near = [*base[:-1], "other"]
    sample = neardup.Sample([" ".join(base), " ".join(base), None, "x y"], 5, 16, 8)
    for text, similar in ((" ".join(near), 1), (" ".join(base), 0), ("x y", 0), ("z", 0)):
        s, met = neardup.shingles(text), np.zeros(9, np.int64)
        own = neardup.signature(s)
        sample.met(s, own, 0.8, met)
        assert met.sum() == similar
        if similar:
            mine, theirs = own.tolist(), neardup.signature(neardup.shingles(" ".join(base))).tolist()
            longest = max(next((k for k in range(8) if a[k] != b[k]), 8) for a, b in zip(mine, theirs, strict=True))
            assert met[longest] == 1


def test_repeated_ids(spark):
    rng = np.random.default_rng(3)
    a, b = (" ".join(f"w{k}" for k in rng.integers(0, 900, 40)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, b, "y"), (3, b, "z"), (None, a, "x"), (4, None, "x"), (5, " ", "x")]
    docs = spark.createDataFrame(rows, KIND).withColumns({"rep": F.lit(1), "text_hash": F.lit(2)})
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(t for _, t in left if t) == sorted([a, b]) and sorted(i for i, t in left if not t) == [4]
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_long_texts_and_large_groups(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 9000, 3000)]
    texts = [" ".join([*base[:k], f"y{k}", *base[k:]]) for k in range(0, 3000, 60)]
    rows = neardup.similarity_join(spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], KIND), block=60_000).collect()
    assert {(r["class_id"], r["n_links"]) for r in rows} == {(0, len(texts) - 1)}
