import random

import pytest
from pyspark.sql import functions as F

from lantern.operators import matching


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def named(n, seed):
    rnd = random.Random(seed)
    return sorted({"CUSTOMER " * (k % 5 > 0) + "".join(rnd.choices("012", k=rnd.randrange(3, 8))) for k in range(n)})


@pytest.mark.parametrize("most", [1, 2])
def test_names_that_share_a_segment_meet_by_deletions(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "COMMON", 5)
    met, shorter = [], matching._shorter
    monkeypatch.setattr(matching, "_shorter", lambda s, n: met.append(n) or shorter(s, n))
    a, b = named(150, 1), named(150, 2)
    left, right = (spark.createDataFrame([(1, x) for x in names], f"block int, {c} string") for names, c in ((a, "a"), (b, "b")))
    found = [tuple(r) for r in matching.near_names(left, right, "block", lambda n: F.lit(most), most).collect()]
    assert met and sorted(found) == sorted((1, x, y, distance(x, y)) for x in a for y in b if distance(x, y) <= most)


def test_pairs_by_rising_distance_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "COMMON", 5)
    a, b = named(120, 3), named(120, 4)
    ours, official = (spark.createDataFrame([(1, k, x) for k, x in enumerate(names)], "block int, ord int, name string") for names in (b, a))
    only_a, only_b = sorted({*a} - {*b}), sorted({*b} - {*a})
    limit = lambda n: 1 if n <= 6 else 2 if n <= 10 else 3 if n <= 16 else 4
    used, wanted = set(), []
    for d, x, y in sorted((distance(x, y), x, y) for x in only_a for y in only_b):
        if d <= limit(min(len(x), len(y))) and ("a", x) not in used and ("b", y) not in used:
            used |= {("a", x), ("b", y)}
            wanted.append((x, y, d))
    got = matching.name_difference(ours, official, "block").where("kind = 'mismatch'").collect()
    assert sorted((r["official"], r["ours"], r["distance"]) for r in got) == sorted(wanted)
