"""Tables that grow with the input are joined by shuffling, whatever size their files seem to have."""

import random
import re

from pyspark.sql import functions as F

from lantern.operators import matching

#: One row for each block, or for each length of its names.
FEW = ({"block"}, {"block", "size"})


def broadcast_keys(df):
    """The keys of each join of the plan that broadcasts a table."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [set(re.findall(r"(\w+)#\d+", keys)) for keys in re.findall(r"BroadcastHashJoin \[([^]]*)\]", plan)]


def spied(monkeypatch):
    found, kept = [], matching.kept
    monkeypatch.setattr(matching, "kept", lambda df: found.extend(broadcast_keys(df)) or kept(df))
    return found


def lists(spark, n):
    draw = random.Random(5)
    made = [(k % 2, k, f"KONAK {''.join(draw.choices('abc', k=6))}") for k in range(n)]
    ours = [(b, k, name[:-1] + "x" if k % 5 == 0 else name) for b, k, name in made if k % 7]
    return (spark.createDataFrame(x, "block int, ord int, name string") for x in (ours, made))


def test_name_difference_broadcasts_no_names(spark, monkeypatch):
    for name, value in {"COMMON": 3, "ROUNDS": 1}.items():
        monkeypatch.setattr(matching, name, value)
    found = spied(monkeypatch)
    diff = matching.name_difference(*lists(spark, 120), "block")
    assert diff.where("kind <> 'matched'").count() > 20
    assert all(keys in FEW for keys in found + broadcast_keys(diff)), found


def test_large_blocks_broadcast_no_pairs(spark, monkeypatch):
    found = spied(monkeypatch)
    near = [(1, f"a{k}", f"b{k + j}", j) for k in range(30) for j in (0, 1)]
    pairs = matching.greedy_pairs("block", "a", "b", spark.createDataFrame(near, "block int, a string, b string, distance int"), rounds=1, most=5)
    assert pairs.count() == 30
    assert all(keys in FEW for keys in found), found


def test_best_match_broadcasts_no_candidates(spark, monkeypatch):
    for name, value in {"COMMON": 3, "PART": 7}.items():
        monkeypatch.setattr(matching, name, value)
    found = spied(monkeypatch)
    rows, candidates = lists(spark, 120)
    rows = rows.select("block", F.col("ord").alias("row_id"), "name", F.lit("Buca").alias("district"), F.lit("").alias("phone"))
    candidates = candidates.select("block", "ord", F.col("name").alias("canonical_name"), F.lit("Buca").alias("district_name"), F.lit("").alias("phone"))
    best = matching.best_match(rows, candidates, ["block"])
    assert best.count() == rows.count()
    assert not found + broadcast_keys(best), found


def test_severity_of_lists_broadcasts_no_names(spark, monkeypatch):
    monkeypatch.setattr(matching, "COMMON", 3)
    found = spied(monkeypatch)
    severity = matching.difference_severity(matching.name_difference(*lists(spark, 120), "block"), "block")
    assert severity.count() == 2
    assert all(keys in FEW for keys in found + broadcast_keys(severity)), found
