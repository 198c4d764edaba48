"""Repair of conversations against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from lantern.llm import turns

KIND = "conv_id long, turn long, role string, text string, cost string"
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows, faults):
    """Tries all ways in order of their cost, those whose roles can't come to fit left out."""
    short, open_ways, done = {"user": "u", "assistant": "a"}, [(0, "", 0, "", ())], []
    while open_ways and (not done or open_ways[0][0] <= done[0][0]):
        cost, audit, k, roles, out = heapq.heappop(open_ways)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            done.append((cost, audit, out))
        ways = [(cost + 2, audit + "I", k, roles + short[r], (*out, (r, ""))) for r in short]
        if k < len(rows):
            role, text = rows[k]
            ways.append((cost + 3, audit + "D", k + 1, roles, out))
            if faults[k] not in ("blank", "duplicate"):
                more = cost + (faults[k] == "truncated")
                ways.append((more, audit + "K", k + 1, roles + (role[:1] or "-"), (*out, (role, text))))
                ways += [(more + 2, audit + "R", k + 1, roles + short[r], (*out, (r, text))) for r in short]
        for way in ways:
            if re.fullmatch("s?(ua)*u?", way[3]):
                heapq.heappush(open_ways, way)
    return min(done)


def plain(rows):
    """rows: conv_id, turn, role, text in order of the turns."""
    found = []
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        faults, seen = [], set()
        for _, role, text in mine:
            ends = SEEN.findall(text)
            faults.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, out = cheapest([x[1:] for x in mine], faults)
        known = {x[0] for x in mine if x[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(found, key=str)


def some(seed, n=60):
    draw, rows = random.Random(seed), []
    for conv in range(n):
        for turn in sorted(draw.sample(range(9), draw.randint(1, 3))):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice(["Yes.", "No!  ", "cut off", "", " \t\n", " ", None, "Yes."])))
    return rows


def repaired(spark, rows, **more):
    return sorted((tuple(r) for r in turns.repair(turns.damaged(spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(3)), **more).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_exhaustive_search(spark, seed):
    rows = some(seed)
    want = plain(rows)
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, longest=1, segment=1) == want
    assert repaired(spark, rows, longest=2, segment=2) == want


def test_nulls_and_no_turns(spark):
    rows = [(None, None, None, None), (5, None, "user", "A."), (5, 3, "assistant", "B."), (5, 4, "assistant", "B."), (6, 1, "user", "?")]
    rows += [(c, 0, "user", "x.") for c in range(7, 60)]  # some lose their only turn
    want = plain(rows)
    assert any(r[-2] == "" and r[6] == 0 for r in want)
    assert repaired(spark, rows) == want == repaired(spark, rows, longest=0, segment=1)
    assert turns.repair(spark.createDataFrame([], KIND)).count() == 0


def test_long_conversation_goes_by_segments(spark):
    draw = random.Random(9)
    rows = [(1, t // 2, draw.choice(["user", "assistant", "system"]), draw.choice(["Yes.", "No", f"Say {t}.", ""])) for t in range(3000)]
    rows += [(1, 7, "user", "Same.")] * 500 + [(2, t, "user", "Hi.") for t in range(5)]
    whole = repaired(spark, rows, longest=10_000)
    assert repaired(spark, rows, longest=900, segment=64) == whole
    assert repaired(spark, rows, longest=900, most_chars=2000, segment=333) == whole
    many = spark.createDataFrame(rows, KIND[: KIND.index(", cost")])
    lines = {}
    for r in turns.repaired_turns(turns.damaged(many), longest=900, segment=100).orderBy("conv_id", "part", "segment", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {r[0]: r[-1] for r in whole}
