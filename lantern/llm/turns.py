"""Repair of the structure of conversations: cheapest edits that bring the roles into a grammar.

The grammar is nothing, or an optional system turn and then pairs of a user and an assistant turn. Its four states are the
start, after the system turn, after a user turn and after an assistant turn. A forward Viterbi pass over the turns of a
conversation carries the least (cost, audit string) of each state; after each turn insertions close the layer. Of two
audits of one layer and cost none begins with the other (it would have more insertions, so another cost), so the least one
stays the least whatever follows, and passes over parts of a conversation can be joined at their states.

Conversations of bounded size are repaired in one group each. Longer ones are cut into segments of a bounded number of turns;
each segment has its pass from every state, a fold over the segments picks the cheapest way, and the segments are edited apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import written

#: Edits by their initial. The state after an inserted or rewritten turn, and the role that it has.
STEP, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state after a turn that is kept, by the state before and the initial of its role.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Pairs of initials that may stand side by side.
LEGAL = {"su", "ua", "au"}
#: White space, and ends of sentences.
SPACE, END = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"

Layer = list[tuple[int, str] | None]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `copies` of every row after a damage chosen by crc32(conv_id:turn) % 20: 0 drops the row
    (copies 0), 1 empties its text, 2 takes its [.!?] away, 3 repeats it (copies 2), 4 makes its role user. Nulls of role
    and text, and in the hashed text of conv_id and turn, are one space; conv_id and turn themselves stay null."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def fault(text: str, seen_before: bool) -> str:
    """The first fault of a turn: blank, duplicate, truncated, or none (empty)."""
    last = text.rstrip(SPACE)[-1:]
    return "blank" if not last else "duplicate" if seen_before else "truncated" if last not in END else ""


def close(layer: Layer) -> None:
    """Adds insertions; three rounds reach every state from every other."""
    for _ in range(3):
        for state in range(4):
            if layer[state]:
                cost, audit = layer[state]
                come, to = (cost + INSERT, audit + "I"), STEP[state]
                if layer[to] is None or come < layer[to]:
                    layer[to] = come


def forward(layer: Layer, role: str, found: str) -> Layer:
    """The layer after a turn."""
    after: Layer = [None] * 4
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        ways = [(state, cost + DELETE, "D")]
        if found not in ("blank", "duplicate"):
            extra = TRUNCATED if found else 0
            ways.append((STEP[state], cost + REROLE + extra, "R"))
            if (to := KEPT.get((state, role[:1]))) is not None:
                ways.append((to, cost + KEEP + extra, "K"))
        for to, total, edit in ways:
            come = (total, audit + edit)
            if after[to] is None or come < after[to]:
                after[to] = come
    close(after)
    return after


def began(state: int) -> Layer:
    layer: Layer = [None] * 4
    layer[state] = (0, "")
    return layer


def edited(state: int, audit: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns after an audit's edits, from a state on."""
    out, left = [], iter(turns)
    for edit in audit:
        if edit == "I":
            out.append((ROLE[state], ""))
            state = STEP[state]
            continue
        role, text = next(left)
        if edit == "R":
            out.append((ROLE[state], text))
            state = STEP[state]
        elif edit == "K":
            out.append((role, text))
            state = KEPT[state, role[:1]]
    return out


def best_of(layer: Layer) -> tuple[int, str]:
    return min(x for x in (layer[0], layer[3]) if x)


def _tally(faults: list[str], roles: list[str]) -> list[int]:
    return [*(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))]


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, part int, segment long, place int, role string, text string"


def _short(rows: DataFrame, texts: bool) -> DataFrame:
    """Conversations that fit a group: a summary and a digest each, or their repaired turns."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("known", "ascending"), ("place", "ascending"), ("role", "ascending"), ("digest", "ascending")])
        columns = [group[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")]
        turns, numbers = [], []
        for _, turn, role, text, copies in zip(*columns, strict=True):
            turns += [(role, text)] * copies
            numbers += [turn] * copies
        layer, seen, faults = began(0), set(), []
        close(layer)
        for role, text in turns:
            faults.append(fault(text, (role, text) in seen))
            seen.add((role, text))
            layer = forward(layer, role, faults[-1])
        cost, audit = best_of(layer) if turns else (0, "")
        repaired, conv = edited(0, audit, turns), columns[0][0]
        if texts:
            n = len(repaired)
            data = {"conv_id": [conv] * n, "part": [0] * n, "segment": [0] * n, "place": list(range(n)), "role": [r for r, _ in repaired], "text": [t for _, t in repaired]}
            return pa.table(data, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string())]))
        known = {x for x in numbers if x is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        values = [conv, gaps, *_tally(faults, [r for r, _ in turns]), cost, audit, digest]
        return pa.table([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in values], names=[*(c.split()[0] for c in SUMMARY.split(", ")), "repaired_sha256"])

    return rows.groupBy("conv").applyInArrow(run, TURNS if texts else f"{SUMMARY}, repaired_sha256 string")


class _Long:
    """Conversations that don't fit a group, in segments of bounded size."""

    ORDER = ["conv", "known", "place", "role", "digest", "id"]

    def __init__(self, rows: DataFrame, segment: int, parts: int) -> None:
        position = F.struct("known", "place", "id")
        copies = rows.where("copies > 0").withColumn("id", F.explode(F.expr("sequence(id * 2, id * 2 + copies - 1)")))
        firsts = copies.groupBy("conv", "role", "digest").agg(F.min(position).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        flagged = copies.join(firsts, ["conv", "role", "digest"], "left").withColumn("again", F.coalesce(position > F.col("first"), F.lit(False)))
        # a range of all orders' columns splits a conversation, a turn and equal rows
        ranged = flagged.repartitionByRange(parts, *self.ORDER).sortWithinPartitions(*self.ORDER)
        self.turns = written(ranged.select("conv", "conv_id", "turn", "role", "text", "again").mapInArrow(self._numbered(segment), "conv string, conv_id long, turn long, role string, text string, again boolean, part int, segment long, at int"), "long-turns")
        self.rows = rows
        self.pieces = self.turns.groupBy("conv", "part", "segment").applyInArrow(self._piece, self.PIECE)
        self.folded = written(self.pieces.groupBy("conv").applyInArrow(self._fold, self.FOLDED), "long-folded")

    @staticmethod
    def _numbered(segment: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, before = TaskContext.get().partitionId(), 0
            for batch in batches:
                places = range(before, before + len(batch))
                before += len(batch)
                more = [pa.array([part] * len(batch), pa.int32()), pa.array([x // segment for x in places], pa.int64()), pa.array([x % segment for x in places], pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "segment", "at"])

        return run

    WAYS = ", ".join(f"cost{a}{b} long, audit{a}{b} string" for a in range(4) for b in range(4))
    PIECE = f"conv string, conv_id long, part int, segment long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, {WAYS}"
    FOLDED = "conv string, conv_id long, part int, segment long, state int, edits string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"

    @staticmethod
    def _piece(group: pa.Table) -> pa.Table:
        """The passes over a segment from every state, and what it tells of faults and turns."""
        group = group.sort_by("at")
        conv, ids, part, segment = (group[c][0].as_py() for c in ("conv", "conv_id", "part", "segment"))
        roles, again, numbers = (group[c].to_pylist() for c in ("role", "again", "turn"))
        faults = [fault(text, dup) for text, dup in zip(group["text"].to_pylist(), again, strict=True)]
        ways: list = []
        for state in range(4):
            layer = began(state)
            for role, found in zip(roles, faults, strict=True):
                layer = forward(layer, role, found)
            for way in layer:
                ways += way or (None, None)
        known = [x for x in numbers if x is not None]
        values = [conv, ids, part, segment, *_tally(faults, roles), roles[0][:1], roles[-1][:1], min(known, default=None), max(known, default=None), len(set(known)), *ways]
        return _table(_Long.PIECE, [values])

    @staticmethod
    def _fold(group: pa.Table) -> pa.Table:
        """The cheapest way through the segments of a conversation, and its total."""
        pieces = sorted(group.to_pylist(), key=lambda x: (x["part"], x["segment"]))
        layer, through = began(0), []
        close(layer)
        for piece in pieces:
            after: Layer = [None] * 4
            came: list[int | None] = [None] * 4
            for a in range(4):
                for b in range(4):
                    if layer[a] and piece[f"cost{a}{b}"] is not None:
                        way = (layer[a][0] + piece[f"cost{a}{b}"], layer[a][1] + piece[f"audit{a}{b}"])
                        if after[b] is None or way < after[b]:
                            after[b], came[b] = way, a
            layer = after
            through.append(came)
        cost, audit = best_of(layer)
        state = 0 if layer[0] == (cost, audit) else 3
        steps = []
        for came in reversed(through):
            steps.append((came[state], state))
            state = came[state]
        steps.reverse()
        opening = "I" * (len(audit) - sum(len(p[f"audit{a}{b}"]) for p, (a, b) in zip(pieces, steps, strict=True)))
        known = [p for p in pieces if p["low"] is not None]
        distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        totals = [sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")]
        totals[3] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(pieces, pieces[1:]))
        out = []
        for k, (piece, (a, b)) in enumerate(zip(pieces, steps, strict=True)):
            edits = piece[f"audit{a}{b}"] if k else opening + piece[f"audit{a}{b}"]
            rest = [*totals, gaps, cost, audit] if not k else [None] * 7
            out.append([piece["conv"], piece["conv_id"], piece["part"], piece["segment"], a if k else 0, edits, *rest])
        return _table(_Long.FOLDED, out)

    @staticmethod
    def _edit(turns: pa.Table, folded: pa.Table) -> pa.Table:
        turns, way = turns.sort_by("at"), folded.to_pylist()[0]
        out = edited(way["state"], way["edits"], list(zip(turns["role"].to_pylist(), turns["text"].to_pylist(), strict=True)))
        return _table(TURNS, [[way["conv_id"], way["part"], way["segment"], k, r, t] for k, (r, t) in enumerate(out)])

    def repaired(self) -> DataFrame:
        by = ["conv", "part", "segment"]
        ways = self.folded.select(*by, "conv_id", "state", "edits").groupBy(*by)
        return self.turns.groupBy(*by).cogroup(ways).applyInArrow(self._edit, TURNS)

    def summaries(self) -> DataFrame:
        """A digest goes over the whole text, so a conversation's segments run through one task in their order; it holds one at
        a time."""
        by = ["conv", "part", "segment"]
        ways = self.folded.select(*by, "conv_id", "state", "edits").groupBy(*by)

        def packed(turns: pa.Table, folded: pa.Table) -> pa.Table:
            lines = [f"{r}:{t}" for r, t in zip(*(_Long._edit(turns, folded)[c].to_pylist() for c in ("role", "text")), strict=True)]
            way = folded.to_pylist()[0]
            return _table("conv string, part int, segment long, lines binary", [[way["conv"], way["part"], way["segment"], "\n".join(lines).encode() if lines else None]])

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, whole, empty = None, hashlib.sha256(), True
            for batch in batches:
                for conv, lines in zip(batch["conv"].to_pylist(), batch["lines"].to_pylist(), strict=True):
                    if conv != now:
                        if now is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([whole.hexdigest()])], ["conv", "repaired_sha256"])
                        now, whole, empty = conv, hashlib.sha256(), True
                    if lines is not None:
                        whole.update(lines if empty else b"\n" + lines)
                        empty = False
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([whole.hexdigest()])], ["conv", "repaired_sha256"])

        lines = self.turns.groupBy(*by).cogroup(ways).applyInArrow(packed, "conv string, part int, segment long, lines binary")
        found = lines.repartition("conv").sortWithinPartitions(*by).mapInArrow(digests, "conv string, repaired_sha256 string")
        totals = self.folded.where("audit is not null").drop("part", "segment", "state", "edits")
        told = totals.join(found, "conv").select(*(c.split()[0] for c in SUMMARY.split(", ")), "repaired_sha256")
        none = self.rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sum("copies").alias("left")).where("left = 0")
        zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return told.unionByName(none.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))


def _table(schema: str, rows: list[list]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [tuple(x.split()) for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _repair(rows: DataFrame, texts: bool, longest: int, most_chars: int, segment: int) -> DataFrame:
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("place"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce(copies, F.lit(1)).cast("int").alias("copies"),
    ).withColumn("digest", F.sha2("text", 256))
    sizes = rows.groupBy("conv").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.length("text") * F.col("copies")).alias("chars"))
    long = written(sizes.where(f"n > {longest} or chars > {most_chars}").select("conv", "n", "chars"), "long-conversations")
    n, chars = long.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    if not n:
        return _short(rows, texts)
    numbered = rows.withColumn("id", F.monotonically_increasing_id())
    apart = _Long(numbered.join(long.select("conv"), "conv", "left_semi"), segment, max(2, -(-n // max(1, longest)), -(-chars // most_chars)))
    return _short(rows.join(long.select("conv"), "conv", "left_anti"), texts).unionByName(apart.repaired() if texts else apart.summaries())


def repair(rows: DataFrame, longest: int = 20_000, most_chars: int = 16 << 20, segment: int = 1000) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text, and copies if a row stands for several or none): conv_id, gaps
    in the turns, counts of blank, duplicate and truncated turns and of illegal neighbours, cost and audit of the cheapest
    repair, repaired_sha256 of the repaired `role:text` lines.

    Turns come by number, nulls first, those of one number by role and digest of the text, so repeated rows stand side by
    side. Null texts and roles are one space; rows with a null conv_id are a conversation. One without turns (copies 0) has
    zeros, an empty audit and the digest of nothing. Other columns are ignored. Conversations of over `longest` turns or
    `most_chars` characters go by segments, with the same results.
    """
    return _repair(rows, False, longest, most_chars, segment)


def repaired_turns(rows: DataFrame, longest: int = 20_000, most_chars: int = 16 << 20, segment: int = 1000) -> DataFrame:
    """The turns after the repair: conv_id, part, segment and place (their order), role, text; inserted ones have no text."""
    return _repair(rows, True, longest, most_chars, segment)
