import corpus_pipeline
from lantern.llm import mixing, queries

LEAVES = [("a", "x", "1", 100), ("a", "x", "2", 100), ("a", "y", "1", 100), ("b", "x", "1", 100), ("b", "z", "2", 100)]


def given(spark, budget, weights):
    tables = {k: spark.createDataFrame(list(v.items()), f"{k} string, weight double") for k, v in weights.items()}
    found = mixing.leaf_budgets(spark.createDataFrame(LEAVES, "domain string, lang string, source string, tokens long"), budget, 1, tables)
    return [{tuple(r[:3]): r["given"] for r in found.collect()}[x[:3]] for x in LEAVES]


def test_unequal_weights(spark):
    assert given(spark, 80, {"domain": {"a": 3.0}, "lang": {"y": 2.0}, "source": {"2": 3.0}}) == [5, 15, 40, 10, 10]


def test_weight_zero_gets_nothing(spark):
    # source 2 is out, so z has nothing to take; what it would have got goes to its siblings
    assert given(spark, 60, {"source": {"2": 0.0}}) == [15, 0, 15, 30, 0]
    assert given(spark, 60, {"domain": {"b": 0.0}}) == [15, 15, 30, 0, 0]
    assert given(spark, 500, {"lang": {"x": 0.0, "y": -1.0}}) == [0, 0, 0, 0, 100]
    assert given(spark, 60, {"domain": {"a": 0.0, "b": 0.0}}) == [0] * 5


def test_pipeline_mixes_to_target_weights(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "en", f"src{k % 20}", 20) for k in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    counts = {r["source"]: r["count"] for r in corpus_pipeline.mix_sources(spark, docs, "").groupBy("source").count().collect()}
    # domain 1 has src1 with weight 2 and src4 with 3, and src7 with 0; src0 has half the weight of its siblings
    assert "src7" not in counts and counts["src4"] >= counts["src1"] > counts["src10"] and counts["src0"] < counts["src3"]


def test_names_agree_with_the_levels():
    assert list(queries.TARGETS) == mixing.LEVELS


def test_weights_below_a_parent(spark):
    by_parent = spark.createDataFrame([("a", "y", 3.0), ("b", "z", 0.0)], "domain string, lang string, weight double")
    found = mixing.leaf_budgets(spark.createDataFrame(LEAVES, "domain string, lang string, source string, tokens long"), 80, 1, {"lang": by_parent})
    assert [{tuple(r[:3]): r["given"] for r in found.collect()}[x[:3]] for x in LEAVES] == [5, 5, 30, 40, 0]


def test_shares_of_the_query_follow_the_weights(spark):
    """Where no source is short, the tokens taken are as the weights ask, but for the last document of a prefix."""
    docs = spark.createDataFrame([(k, "w " * 10, "en" if k % 2 else "de", f"src{k % 3}", 20) for k in range(6000)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = mixing.mix(docs, queries.domain(), 0.3, 2, weights=queries.target_weights(spark)).groupBy("domain", "lang").agg({"tokens": "sum"}).collect()
    got = {(r["domain"], r["lang"]): r[2] for r in rows}
    total = sum(got.values())
    for d, dw in (("domain0", 1), ("domain1", 3), ("domain2", 2)):
        for lang, lw in (("en", 4), ("de", 2)):
            assert abs(got[d, lang] / total - dw / 6 * lw / 6) < 0.01


def test_budgets_of_a_level_are_made_once(spark):
    """The plan reads the budgets of the last level; it doesn't hold the windows of all levels many times over."""
    weights = {"lang": spark.createDataFrame([("y", 2.0)], "lang string, weight double")}
    found = mixing.leaf_budgets(spark.createDataFrame(LEAVES, "domain string, lang string, source string, tokens long"), 80, 1, weights)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
