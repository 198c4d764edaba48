from lantern import queries


def test_first_ten_occurrences(spark, tmp_path):
    texts = ["the " * 12, "x the", "none", None, "", "a" * 30 + "the" + "b" * 30, "the" * 11]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in queries.QUERIES["or33_keyword_contexts"](spark, str(tmp_path)).collect())
    plain = []
    for k, text in enumerate(texts):
        at = (text or "").find("the")
        for place in range(1, 11):
            if at < 0:
                break
            plain.append((k, place, at + 1, text[max(at - 20, 0) : max(at - 20, 0) + 43]))
            at = text.find("the", at + 3)
    assert rows == plain


def test_whole_token_sets(spark, tmp_path):
    name = "filler " * 100 + "brass"
    spark.createDataFrame([(1, name, "SMALL BRASS"), (2, "steel", "tin"), (3, None, "tin")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, queries.QUERIES["set6_token_sets_whole"](spark, str(tmp_path)).collect())) == [(1, "BRASS"), (2, "")]
