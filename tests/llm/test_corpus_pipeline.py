import corpus_pipeline
from lantern.llm import neardup
from lantern.llm.common import written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "stage")
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert seen[name] <= {r["doc_id"] for r in before.select("doc_id").collect()}
        assert name == "encoding" or docs.columns == columns
        if name == "near copies":
            assert neardup.similarity_join(docs).where("n_links > 0 or n_copies > 1").count() == 0
    clean = {k for k, v in labels.items() if v[1] == 0}
    assert len(seen["toxicity"] & clean) >= 0.97 * len(clean)
    assert len(seen["toxicity"] & (labels.keys() - clean)) <= 0.3 * len(labels.keys() - clean)
    good = {k for k, v in labels.items() if v == (1, 0)} & seen["toxicity"]
    assert len(seen["quality"] & good) >= 0.97 * len(good)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
