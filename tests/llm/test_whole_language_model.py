from collections import Counter

import numpy as np
import pytest
from numpy import log
from pyspark.sql import functions as F

from lantern.llm import lm

TEXTS = ["a b c a b c d", "b c a", "a", "", None, "c d", "x y z"]


def plain(texts, least, order):
    words = [(t or "").split() for t in texts]
    counts = Counter(tuple(w[k : k + n]) for w in words for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(map(len, words))

    def one(run):
        if len(run) == 1:
            return counts[run] / total
        return counts[run] / counts[run[:-1]] if counts[run] >= least else 0.4 * one(run[1:])

    return [sum(log(one(tuple(w[max(k - order + 1, 0) : k + 1]))) for k in range(len(w))) for w in words]


@pytest.mark.parametrize(("least", "order"), [(1, 1), (1, 2), (2, 2), (1, 3), (2, 3), (2, 4)])
def test_orders(spark, least, order):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm.score(docs, least=least, order=order).collect()}
    assert [rows[k]["log_score"] for k in range(len(TEXTS))] == pytest.approx(plain(TEXTS, least, order))


def test_repeated_ids_and_white_space(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b"), (2, "\n\t"), (None, "a b c")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm.score(docs, least=1, order=3).collect()}
    assert rows[1]["n_tokens"] == 5 and rows[1]["log_score"] == pytest.approx(2 * log(2 / 5) + log(1 / 2)) and rows[2]["log_score"] == 0


@pytest.mark.parametrize(("order", "ranges"), [(1, 14), (2, 14), (3, 14), (1, 3), (2, 0), (3, 3)])
def test_many_small_pieces(spark, monkeypatch, order, ranges):
    """Flushes, frequent runs and merges of a bucket's runs, which small texts don't reach; and buckets cut out of ranges."""
    monkeypatch.setattr(lm, "RANGE_BITS", ranges)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, int(rng.integers(0, 60))) if k < 400) for _ in range(300)]
    for name, value in {"FLUSH": 40, "BUCKET_RUNS": 20, "FREQUENT": 50, "PART_DOCUMENTS": 16}.items():
        monkeypatch.setattr(lm, name, value)
    docs = spark.createDataFrame(list(enumerate(texts, -150)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    rows = {r["doc_id"]: r for r in lm.score(docs.repartition(3), order=order).collect()}
    assert [rows[k - 150]["log_score"] for k in range(len(texts))] == pytest.approx(plain(texts, 1, order))
    assert [rows[k - 150]["n_tokens"] for k in range(len(texts))] == [len(t.split()) for t in texts]


def test_no_documents(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in lm.score(spark.createDataFrame([(4, None)], "doc_id long, text string")).collect()] == [(4, 0, 0.0, None)]


@pytest.mark.parametrize("bits", [5, 10, 20])
def test_buckets_beyond_the_ranges(spark, monkeypatch, bits):
    monkeypatch.setattr(lm, "RANGE_BITS", 5)
    docs = spark.createDataFrame([(k, " ".join(f"w{i % 50}" for i in range(200))) for k in range(20)], "doc_id long, text string").coalesce(1)
    table = lm.count_table(docs, 2, bits).collect()
    assert sum(r["tokens"] for r in table) == 4000
    counts = sorted(n for r in table for n in lm._wide(r["counts"], len(r["keys"]) // 8).tolist())
    assert counts == sorted([80] * 50 + [80] * 49 + [60])  # of words, and of pairs
    assert len({r["bucket"] for r in table}) == len(table)


@pytest.mark.parametrize("least", [1, 2])
def test_a_frequent_run_is_looked_up_or_backs_off(least):
    """By counts of a and b, and of the run ab, which is seen once."""
    a, b = np.array([3], np.uint64), np.array([5], np.uint64)
    keys = np.concatenate([a, b, lm.run_key([a, b])])
    order = np.argsort(keys)
    known = lm.Frequent(keys[order], np.array([4, 2, 1])[order], total=8, least=least, backoff=0.4)
    assert known.scores([a, b])[1] == pytest.approx([log(1 / 4) if least == 1 else log(0.4 * 2 / 8)]) and not known.scores([b, a])[0].any()


@pytest.mark.parametrize(("order", "least", "ranges"), [(2, 1, 14), (2, 2, 14), (2, 9, 3), (3, 2, 3), (4, 3, 14)])
def test_pieces_that_back_off(spark, monkeypatch, order, least, ranges):
    """All values of least go the same way: frequent runs, runs in buckets, and further rounds for words that back off."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, int(rng.integers(0, 60))) if k < 400) for _ in range(200)]
    for name, value in {"RANGE_BITS": ranges, "FLUSH": 40, "BUCKET_RUNS": 20, "FREQUENT": 50, "PART_DOCUMENTS": 16}.items():
        monkeypatch.setattr(lm, name, value)
    rounds = []
    monkeypatch.setattr(lm, "written", lambda df, name, to=lm.written: rounds.append(name) or to(df, name))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["log_score"] for r in lm.score(docs.repartition(3), least=least, order=order).collect()}
    assert [rows[k] for k in range(len(texts))] == pytest.approx(plain(texts, least, order))
    assert rounds.count("scores") == (1 if least == 1 else order)
