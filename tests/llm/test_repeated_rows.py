import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from lantern.llm import bpe, mixing, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_keeps_rows_of_repeated_ids_apart(spark):
    rows = [(k % 40, f"{'w ' * (k % 7 + 1)}", "en" if k % 3 else None, f"src{k % 4}", k) for k in range(80)]
    rows += [(1, "same text", "en", "src1", 1)] * 5 + [(None, "x", "en", "src1", 1), (99, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"copies": F.lit("mine"), "key": F.lit(0), "_copy": F.lit(1), "tokens": F.lit("t")})
    for share, epochs in ((0.8, 2), (1.0, 1), (2.0, 2)):
        out = mixing.taken(docs, F.lit("d"), share, epochs)
        assert out.columns == docs.columns
        n = out.count()
        assert n == mixing.mix(docs, F.lit("d"), share, epochs).agg(F.sum("copies")).first()[0]
        words = docs.where("doc_id is not null").agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
        assert out.agg(F.sum(mixing.token_count(F.col("text")))).first()[0] <= words * min(share, epochs)
        assert out.where("doc_id is null or copies <> 'mine'").count() == 0
    whole = mixing.taken(docs, F.lit("d"), 1.0, 1)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, docs.where("doc_id <> 99").collect()))  # a leaf without words has no budget
    assert mixing.taken(docs.limit(0), F.lit("d"), 0.8, 2).count() == 0


def test_stages_of_odd_tables(spark):
    path = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f g", "en", "src1", 9), (2, "a b c d e f g", "en", "src1", 9), (None, "h i", "en", "src1", 3), (3, "x" * 200_000, "de", "src2", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit(7))
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, path)
            assert out.columns == table.columns and out.count() <= table.count() * 2
        assert corpus_pipeline.encode(spark, table, path).count() == table.count()


def test_classifiers_on_repeated_and_empty_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", "en", "s", 1)] * 50 + [(1, "fine words here", "en", "s", 1), (None, None, "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 1, 1), (2, 1, 5)], "doc_id long, quality int, toxic int")
    assert toxicity._training(docs, labels, 10).count() <= 1
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 52 and {r["predicted"] for r in rows if r["doc_id"] is None} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and quality.quality(docs).count() == 52


def test_label_model_needs_no_labels():
    rng = np.random.default_rng(5)
    toxic = rng.random(4000) < 0.2
    chance = np.array([0.5, 0.6, 0.7, 0.4])
    votes = np.where((rng.random((4000, 4)) < chance) & toxic[:, None] | (rng.random((4000, 4)) < 0.01), 1, -1)
    found = toxicity.label_model(votes).posterior(votes)[:, 1] > 0.5
    assert (found == toxic).mean() > 0.95


def test_encoding_of_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1)] * 3 + [(None, None, None, None, None)], DOCS)
    rows = bpe.token_digests(docs, queries.RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 4 and len({r["ids_sha256"] for r in rows if r["doc_id"] == 1}) == 1
    assert bpe.token_digests(docs.limit(0), queries.RANKS, public_tokenizers.PATTERN).count() == 0
