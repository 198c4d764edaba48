from pyspark.sql import functions as F

from lantern.llm import shards


def test_the_store_gives_the_documents_back(spark, tmp_path):
    texts = [(k, "é" * k if k % 5 else None, "en" if k % 3 else None, f"src{k % 4}", k) for k in range(60)]
    docs = spark.createDataFrame([*texts, texts[7], (None, "x", "de", "s", 1)], "doc_id int, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("_arrival", F.concat("source", F.lit("!")))
    path = f"file://{tmp_path}/store"
    rows = shards.sharded(docs, path).collect()
    back = shards.ShardStore(spark, path).read()
    assert back.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    assert sorted((repr(r["doc_id"]), repr(r["n_bytes"])) for r in rows) == sorted((repr(r["doc_id"]), repr(r["text"] and len(r["text"].encode()))) for r in docs.collect())


def test_columns_with_names_of_spark(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, None)], "doc_id long, text string, _metadata string")
    got = shards.sharded(docs, f"file://{tmp_path}/store").collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in got) == [(1, 1), (2, None)]


def test_files_of_a_dead_append_go_after_a_while(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(spark.range(3).withColumnRenamed("id", "doc_id"), 0)
    spark.range(5).write.parquet(f"{tmp_path}/store/data/dead")
    store.vacuum()
    assert (tmp_path / "store/data/dead").exists()
    store.vacuum(orphans=-1)
    assert not (tmp_path / "store/data/dead").exists() and store.read().count() == 3
