"""Matching of names within a block (a province or district): similarity joins, name differences, district resolution."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import numbers, similarity, text
from lantern.operators.tables import kept, shuffled


SKETCH = "size long, low long, high long, shared long, words long, distinct long"


def sketch_of(name: str) -> tuple[int, int, int, int, int, int]:
    """What bounds the similarity of a name to others: its length, its letters as a set of 126 bits (the k-th of a kind counts
    for itself), how many share a bit with another, its words as bits, and the length of the distinct ones."""
    seen, bits, words = Counter(), 0, 0
    for char in name:
        seen[char] += 1
        bits |= 1 << zlib.crc32(f"{char}{seen[char]}".encode()) % 126
    once = dict.fromkeys(name.split())
    for word in once:
        words |= 1 << zlib.crc32(word.encode()) % 63
    return len(name), bits & (1 << 63) - 1, bits >> 63, len(name) - bits.bit_count(), words, len(" ".join(once))


def _sketch(s: Column) -> Column:
    @F.pandas_udf(SKETCH)
    def each(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch_of(n) for n in names], columns=[x.split()[0] for x in SKETCH.split(", ")])

    return each(s)


def _common(a: Column, b: Column) -> Column:
    """At least as many letters as the two have in common."""
    both = F.bit_count(a["low"].bitwiseAND(b["low"])) + F.bit_count(a["high"].bitwiseAND(b["high"])) + F.least(a["shared"], b["shared"])
    return F.least(both, a["size"], b["size"])


def _winkler_bound(common: Column, size_a: Column, size_b: Column) -> Column:
    jaro = (common / size_a + common / size_b + 1) / 3
    return F.when(common > 0, jaro * 0.6 + 0.4).otherwise(0.0)


def _bounded(pairs: DataFrame) -> DataFrame:
    """Adds bound, no smaller than the score of a pair. With so many letters in common, all in order and four at the front,
    Jaro-Winkler is known; edit distance is bounded by the same, and the words in common are no longer than the letters are
    many. Step by step, so that no expression holds another many times."""
    a, b, c, d = (F.col(x) for x in ("r_sketch", "c_sketch", "r_place", "c_place"))
    out = pairs.withColumns({"common": _common(a, b), "same_place": _common(c, d), "least_words": F.least(a["distinct"], b["distinct"])})
    out = out.withColumns({"fewer": F.least("common", "least_words"), "by_place": _winkler_bound(F.col("same_place"), c["size"], d["size"])})
    out = out.withColumns({
        "by_letters": _winkler_bound(F.col("common"), a["size"], b["size"]),
        "by_words": _winkler_bound(F.col("fewer"), a["distinct"], b["distinct"]),
        "by_held": F.when((a["words"].bitwiseAND(b["words"]) != 0) & (F.col("fewer") > 0), (2 + F.col("fewer") / F.col("least_words")) / 3 * 0.6 + 0.4).otherwise(0.0),
        "by_phone": numbers.phone_signal(F.col("r_phone"), F.col("c_phone")),
    })
    name = F.when(F.col("r_name") == F.col("c_name"), 1.0).otherwise(F.least(F.lit(1.0), F.greatest("by_letters", "by_words", "by_held")))
    place = F.when((F.col("r_district") == "") | (F.col("c_district") == ""), 0.0).when(F.col("r_district") == F.col("c_district"), 1.0).otherwise(F.col("by_place"))
    return out.withColumn("bound", numbers.match_score(name, place, F.col("by_phone")) + 1e-9)


#: Names of a block that hold the same segment in the same place, from which on they meet by what deletions leave of them;
#: candidates of a block that hold the same word or phone, from which on rows with it meet all of their block.
COMMON = 100
#: Rows of a block that meet all of its candidates in one task.
PART = 4096


def _name_keys(block: list[str], name: Column, own: str, other: str) -> Column:
    """Keys under which a name meets those whose letters, in any order, are the same but for one that either has more: its
    letters under `own`, what is left of them when one goes under `other`. So do its distinct words in their order."""
    words = F.array_join(F.array_sort(F.array_distinct(F.split(name, " "))), " ")
    letters = F.array_distinct(F.transform(F.array(name, words), lambda t: F.array_join(F.array_sort(F.split(t, "")), "")))
    less = F.array_distinct(F.flatten(F.transform(letters, lambda t: F.filter(_shorter(t, 1), lambda u: F.length(u) < F.length(t)))))
    key = lambda kind: lambda t: F.xxhash64(*block, F.lit(kind), t)
    return F.concat(F.transform(letters, key(own)), F.transform(letters, key("same")), F.transform(less, key(other)))


def _signal_keys(block: list[str], name: Column, phone: Column) -> Column:
    """Keys of a name's words and of the end of a phone."""
    words = F.transform(F.filter(F.array_distinct(F.split(name, " ")), lambda t: t != ""), lambda t: F.xxhash64(*block, F.lit("word"), t))
    return F.concat(words, F.when(phone != "", F.array(F.xxhash64(*block, F.lit("phone"), F.right(phone, F.lit(7))))).otherwise(F.array().cast("array<long>")))


def _apart(name: Column, district: Column) -> Column:
    """No smaller than the score of a row with a candidate that it has no key in common with. Their letters differ by two at
    least, so Jaro is at most that of a candidate with two letters more, and four at the front add 0.4 of what is missing;
    edit distance is no better; no word and no phone is in both. Empty names are alike only to each other, and these meet."""
    return numbers.match_score(F.when(name == "", 0.0).otherwise(1 - 2 / (5 * (F.length(name) + 2))), F.when(district == "", 0.0).otherwise(1.0), F.lit(0.0))


def best_match(rows: DataFrame, candidates: DataFrame, block: list[str], verified: list[DataFrame] | None = None) -> DataFrame:
    """The best candidate of each row of the same block: 0.60 name, 0.25 phone, 0.15 district (Jaro-Winkler of the two); a
    missing signal counts 0 and the first of equal candidates (by ord) wins. A row without candidates is no_match.

    Exact, but few pairs are met. Rows meet the candidates of about the same letters by keys, then those with a word or the
    end of a phone in common. A row whose best score is above what any other candidate can reach is done; the others, and
    those with a very common word or phone, meet the bounds of all of their block. Where sketches bound the pairs in the
    JVM, the candidate of the greatest bound is verified first, then only those whose bound reaches the best score. rows:
    block, row_id, name, district, phone. candidates: block, ord, canonical_name, district_name, phone. To `verified` goes a
    table of the pairs that were.
    """
    c = candidates.select(*block, "ord", "canonical_name", text.pharmacy_name(F.col("canonical_name")).alias("c_name"), text.district_name(F.col("district_name")).alias("c_district"), text.digits(F.col("phone")).alias("c_phone"))
    r = rows.select(*block, "row_id", "name", text.district_name(F.col("district")).alias("r_district"), text.digits(F.col("phone")).alias("r_phone"), text.pharmacy_name(F.col("name")).alias("r_name"))
    # rows that tell the same meet the candidates once, and of candidates that do only the first can win
    told, tells = [*block, "r_name", "r_district", "r_phone"], [*block, "c_name", "c_district", "c_phone"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows make many pairs: none of their partitions are joined up
    there = lambda df: df.where(" and ".join(f"{b} is not null" for b in block))
    asked = shuffled(kept(there(r).select(*told).distinct().repartition(parts).withColumn("a_id", F.monotonically_increasing_id())))
    c = there(c).groupBy(*tells).agg(F.min(F.struct("ord", "canonical_name")).alias("first")).select(*tells, "first.*")
    c = shuffled(kept(c.repartition(parts).withColumn("c_id", F.monotonically_increasing_id())))
    phone, known = numbers.phone_signal(F.col("r_phone"), F.col("c_phone")), (F.col("r_district") != "") & (F.col("c_district") != "")

    def scored(ids: DataFrame) -> DataFrame:
        some = ids.join(asked, "a_id").join(c, ["c_id", *block])
        district = F.when(known, F.when(F.col("r_district") == F.col("c_district"), 1.0).otherwise(similarity.jaro_winkler(F.col("r_district"), F.col("c_district"))))
        return some.withColumn("score", numbers.match_score(similarity.best_similarity(F.col("r_name"), F.col("c_name")), district, phone))

    def best(ids: DataFrame) -> DataFrame:
        if verified is not None:
            verified[:] = [reduce(DataFrame.unionByName, [*verified, ids])]
        return kept(scored(ids).groupBy("a_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("behind"), "canonical_name")).alias("top")))

    def sketched() -> tuple[DataFrame, DataFrame]:
        both = (asked, "r", "a_id"), (c, "c", "c_id")
        return tuple(shuffled(kept(df.select(*block, i, *[f"{x}_{n}" for n in ("name", "district", "phone")], _sketch(F.col(f"{x}_name")).alias(f"{x}_sketch"), _sketch(F.col(f"{x}_district")).alias(f"{x}_place")))) for df, x, i in both)

    def reached(some: Callable[[DataFrame], DataFrame], of: DataFrame, tops: DataFrame) -> DataFrame:
        """Of the pairs that some makes, of rows, those whose bound reaches the score of the row's best one so far, and of the
        likeliest of them. tops: a_id and least."""
        pairs = _bounded(some(of)).select("a_id", "c_id", "bound", F.bit_count(F.col("r_sketch.words").bitwiseAND(F.col("c_sketch.words"))).alias("alike"))
        # one number holds bound, words in common and candidate, so that its maximum is a plain sum of the tasks' ones
        packed = F.shiftleft(F.floor(F.col("bound") * (1 << 14)).cast("long"), 48) + F.shiftleft(F.least("alike", F.lit(31)).cast("long"), 43) + F.col("c_id") % (1 << 43)
        likely = pairs.groupBy("a_id").agg((F.max(packed) % (1 << 43)).alias("c_id"))
        least = shuffled(kept(scored(likely).select("a_id", F.col("score").alias("least")).unionByName(tops).groupBy("a_id").agg(F.max("least").alias("least"))))
        # not a filter, which would be moved into the join with all steps of the bound written out
        over = F.explode(F.when(F.col("bound") >= F.coalesce("least", F.lit(0.0)), F.array("c_id")))
        return kept(_bounded(some(of.join(least, "a_id", "left"))).select("a_id", over.alias("c_id")))

    keyed = lambda df, i, keys: df.select(i, F.explode(keys).alias("key"))
    near = keyed(asked, "a_id", _name_keys(block, F.col("r_name"), "more", "less")).join(keyed(c, "c_id", _name_keys(block, F.col("c_name"), "less", "more")), "key")
    found = [best(near.select("a_id", "c_id").distinct())]
    r_signals, c_signals = keyed(asked, "a_id", _signal_keys(block, F.col("r_name"), F.col("r_phone"))), keyed(c, "c_id", _signal_keys(block, F.col("c_name"), F.col("c_phone")))
    common = kept(c_signals.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("key"))
    shared = shuffled(kept(r_signals.join(c_signals.join(common, "key", "left_anti"), "key").select("a_id", "c_id").distinct()))
    tops = lambda: reduce(DataFrame.unionByName, found).groupBy("a_id").agg(F.max("top").alias("top"))
    least = lambda: tops().select("a_id", F.col("top.score").alias("least"))
    made: list[tuple[DataFrame, DataFrame]] = []
    if not shared.isEmpty():
        made.append(sketched())
        found.append(best(reached(lambda of: shared.join(of, "a_id").join(made[0][1].drop(*block), "c_id"), made[0][0], least())))
    apart = _apart(F.col("r_name"), F.col("r_district"))
    often = shuffled(r_signals.join(common, "key", "left_semi").select("a_id").distinct().withColumn("often", F.lit(True)))
    of = asked.join(least(), "a_id", "left").join(often, "a_id", "left")
    rest = kept(of.where((F.col("often") | (F.coalesce("least", F.lit(0.0)) <= apart + 1e-9)) & (F.col("often").isNotNull() | (apart > 0))).select("a_id"))
    if not rest.isEmpty():
        made = made or [sketched()]
        mine = made[0][0].join(rest, "a_id", "left_semi")
        # rows of a block go in parts of about PART rows; a copy of its candidates meets each
        many = shuffled(mine.groupBy(*block).agg(F.ceil(F.count("*") / PART).alias("many")))
        mine = mine.join(many, block).withColumn("part", F.pmod(F.xxhash64("a_id"), F.col("many"))).drop("many")
        copies = made[0][1].join(many, block).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).drop("many")
        found.append(best(reached(lambda of: of.join(shuffled(copies), [*block, "part"]), mine, least())))
    top = shuffled(asked.join(tops(), "a_id").select(*told, "top"))
    out = r.select("row_id", "name", *told).join(top, told, "left")
    s = F.coalesce("top.score", F.lit(0.0))
    kind = numbers.match_type(s)
    return out.select("row_id", "name", F.when(kind != "no_match", F.col("top.canonical_name")).alias("match"), kind.alias("match_type"), F.when(kind != "no_match", F.round(s, 3)).otherwise(s).alias("confidence"))


def _segment(length: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Begin (from 1) and length of the i-th of n nearly equal segments of a text."""
    begin = F.floor(i * length / n).cast("int")
    return begin + 1, F.floor((i + 1) * length / n).cast("int") - begin


def _shorter(s: Column, most: int) -> Column:
    """All that is left of a text when up to so many letters are deleted."""
    left = F.array(s)
    for _ in range(most):
        cut = lambda t: F.transform(F.sequence(F.lit(0), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i), F.substr(t, i + 2, F.length(t))))
        left = F.array_distinct(F.flatten(F.transform(left, cut)))
    return left


def near_names(left: DataFrame, right: DataFrame, block: str, limit: Callable[[Column], Column], shorter: int = 0) -> DataFrame:
    """block, a, b and distance of all pairs of names of a block whose edit distance is at most limit of the shorter one's
    length. left: block and a; right: block and b; limit grows with the length.

    A text with k edits keeps one of its k + 1 segments as it was: the first i of which no more than i - 1 have edits, so this
    one is moved by i - 1 places at most from the front, and by what edits are left from the end. Names meet by the length of
    b, a segment's number and its letters instead of all with all of their block; what meets is verified before pairs are
    sent. With `shorter`, no less than limit, names with a segment that COMMON others have meet by what up to so many
    deletions leave of both.
    """
    size, most = F.length("b"), limit(F.length("b"))
    cut = lambda i: F.substr(F.col("b"), *_segment(size, most + 1, i))
    key = lambda: F.xxhash64(block, "size", "i", "part").alias("key")
    held = right.select(block, "b", size.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(0), most), cut)).alias("i", "part")).select(block, "b", key())
    sizes = right.select(block, size.alias("size")).distinct()
    reach = limit(F.lit(1_000))  # the largest limit that there is
    asked = left.select(block, "a", F.explode(F.sequence(F.greatest(F.length("a") - reach, F.lit(1)), F.length("a") + reach)).alias("size"))
    asked = asked.withColumn("most", limit(F.col("size"))).where(F.abs(F.length("a") - F.col("size")) <= F.col("most")).join(sizes, [block, "size"], "left_semi")
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    begin, length = _segment(F.col("size"), F.col("most") + 1, F.col("i"))
    longer, behind = F.length("a") - F.col("size"), F.col("most") - F.col("i")
    low = F.greatest(begin - F.col("i"), begin + longer - behind, F.lit(1))
    high = F.least(begin + F.col("i"), begin + longer + behind, F.length("a") - length + 1)
    parts = F.when(low <= high, F.array_distinct(F.transform(F.sequence(low, F.greatest(low, high)), lambda p: F.substr(F.col("a"), p, length))))
    asked = asked.select(block, "a", "size", "i", F.explode(parts).alias("part")).select(block, "a", key())

    def verified(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = shuffled(a).join(shuffled(b), [block, "key"]).withColumn("distance", F.levenshtein("a", "b", int(shorter)) if shorter else F.levenshtein("a", "b"))
        return pairs.where((F.col("distance") >= 0) & (F.col("distance") <= limit(F.least(F.length("a"), F.length("b"))))).select(block, "a", "b", "distance")

    if not shorter:
        return verified(asked, held).distinct()
    common = kept(held.groupBy(block, "key").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select(block, "key"))
    if common.isEmpty():
        return verified(asked, held).distinct()
    many = shuffled(held).join(common, [block, "key"], "left_semi").select(block, "b").distinct()
    cuts = lambda df, name: df.select(block, name, F.explode(_shorter(F.col(name), shorter)).alias("part")).select(block, name, F.xxhash64("part").alias("key"))
    by_segment = verified(asked, shuffled(held).join(many, [block, "b"], "left_anti"))
    return by_segment.unionByName(verified(cuts(left.where(F.col("a").isNotNull()), "a"), cuts(many, "b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node that edges (x, y) lead to. Alternating stars: each node hangs its larger, then
    its smaller neighbours onto the smallest one, so rounds grow with the logarithm of the longest path."""
    edges, before = kept(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = shuffled(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        down = shuffled(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(down, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(down.select("x", F.col("m").alias("y")))
        edges = kept(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
        before = now


#: Rounds after which pairs that wait for each other are taken by component, and the pairs of a component that a task takes.
ROUNDS, COMPONENT = 3, 1_000_000


def greedy_pairs(block: str, a: str, b: str, near: DataFrame, rounds: int = ROUNDS, most: int = COMPONENT) -> DataFrame:
    """One-to-one pairs in the order of (distance, a, b): a pair holds if neither of its names has one already.

    near: the block, a, b and distance. A block of bounded size is solved in a group. In larger ones each round takes the pairs that come first for both of their names. Most names are
    done then; of the others, which wait for one another in chains, each component of bounded size is solved in a group of
    its own, so chains of any length take no more rounds. Larger components go on by rounds. What is left after a round is a
    table in the shared folder.
    """
    out, near = [], kept(near)

    def first(of: str) -> DataFrame:
        return near.groupBy(block, of).agg(F.min(F.struct("distance", F.col(a).alias("x"), F.col(b).alias("y"))).alias("m")).select(block, F.col("m.x").alias(a), F.col("m.y").alias(b), F.col("m.distance").alias("distance"))

    def solved(group: pa.Table) -> pa.Table:
        group, used_a, used_b, held = group.sort_by([("distance", "ascending"), (a, "ascending"), (b, "ascending")]), set(), set(), []
        for k, (x, y) in enumerate(zip(group[a].to_pylist(), group[b].to_pylist(), strict=True)):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                held.append(k)
        return group.take(held).select([block, a, b, "distance"])

    columns, done = [block, a, b, "distance"], 0
    of = near.join(near.groupBy(block).agg(F.count("*").alias("_n")), block)
    out.append(kept(of.where(F.col("_n") <= most).select(*columns).groupBy(block).applyInArrow(solved, near.select(*columns).schema)))
    near = kept(of.where(F.col("_n") > most).select(*columns))
    if near.isEmpty():
        return out[0]
    while True:
        if done == rounds:
            hashed = near.withColumns({"_x": F.xxhash64(F.lit("a"), block, a), "_y": F.xxhash64(F.lit("b"), block, b)})
            of = shuffled(hashed).join(components(hashed.select(F.col("_x").alias("x"), F.col("_y").alias("y"))).select(F.col("node").alias("_x"), "component"), "_x")
            of = kept(of.join(shuffled(of.groupBy("component").agg(F.count("*").alias("_n"))), "component"))
            small = of.where(F.col("_n") <= most)
            out.append(kept(small.select(*columns, "component").groupBy("component", block).applyInArrow(solved, near.select(*columns).schema)))
            near = kept(of.where(F.col("_n") > most).select(*columns))
        taken = shuffled(kept(shuffled(first(a)).join(first(b), [block, a, b, "distance"], "left_semi")))
        done += 1
        if taken.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(taken)
        near = kept(near.join(taken.select(block, a), [block, a], "left_anti").join(taken.select(block, b), [block, b], "left_anti"))


def name_difference(ours: DataFrame, official: DataFrame, block: str, fixed: int | None = None) -> DataFrame:
    """block, kind (matched, mismatch, missing, extra), official, ours and distance for two lists of names of each block.

    Names are compared normalised, the first raw form (by ord) stands for its group; what is in one list only is paired
    one to one by the smallest edit distance up to a limit that grows with the length. Pairs are only made within a block.
    """
    def firsts(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("norm", text.pharmacy_name(F.col("name"))).where("norm <> ''").groupBy(block, "norm").agg(F.min_by("name", "ord").alias(name))

    both = firsts(official, "official").join(firsts(ours, "ours"), [block, "norm"], "full_outer")
    matched = both.where("official is not null and ours is not null").select(block, F.lit("matched").alias("kind"), "official", "ours", F.lit(0).alias("distance"))
    missing = both.where("ours is null").select(block, F.col("norm").alias("a"), "official")
    extra = both.where("official is null").select(block, F.col("norm").alias("b"), "ours")
    limit = lambda n: F.lit(fixed) if fixed is not None else numbers.distance_for(n)
    found, left, right = [], kept(missing.select(block, "a")), kept(extra.select(block, "b"))
    # pairs go by distance, so most names have theirs before many letters may differ: those of one edit, of two, then the rest
    for most in (1, 2, None):
        if most is None and fixed is not None and fixed <= 2:
            break
        near = near_names(left, right, block, limit) if most is None else near_names(left, right, block, lambda n: F.least(limit(n), F.lit(most)), most)  # noqa: B023
        found.append(shuffled(greedy_pairs(block, "a", "b", near)))
        left, right = (kept(df.join(found[-1], [block, name], "left_anti")) for df, name in ((left, "a"), (right, "b")))
    pairs = shuffled(reduce(DataFrame.unionByName, found))
    mismatch = pairs.join(missing, [block, "a"]).join(shuffled(extra), [block, "b"]).select(block, F.lit("mismatch").alias("kind"), "official", "ours", "distance")
    none = F.lit(None).cast("int").alias("distance")
    gone = missing.join(pairs, [block, "a"], "left_anti").select(block, F.lit("missing").alias("kind"), "official", F.lit(None).cast("string").alias("ours"), none)
    more = extra.join(pairs, [block, "b"], "left_anti").select(block, F.lit("extra").alias("kind"), F.lit(None).cast("string").alias("official"), "ours", none)
    return matched.unionByName(mismatch).unionByName(gone).unionByName(more)


def difference_severity(diff: DataFrame, block: str) -> DataFrame:
    n = {k: F.count_if(F.col("kind") == k) for k in ("matched", "mismatch", "missing", "extra")}
    out = diff.groupBy(block).agg(*[v.alias(f"n_{k}") for k, v in n.items()])
    return out.withColumn("severity", F.when(F.col("n_missing") + F.col("n_extra") > 0, "high").when(F.col("n_mismatch") > 0, "medium").otherwise("low"))


# Other spellings of district names, and the slug that they stand for.
DISTRICT_ALIASES = {
    "merkez ilce": "merkez",
    "il merkezi": "merkez",
    "belediye merkezi": "merkez",
    "sehir merkezi": "merkez",
    "ilcemerkezi": "merkez",
    "besiktas": "besiktas",
    "kadikoy": "kadikoy",
    "uskudar": "uskudar",
    "sisli": "sisli",
    "bayrampasa": "bayrampasa",
    "fatih": "fatih",
    "cankaya": "cankaya",
    "kecioren": "kecioren",
    "mamak": "mamak",
    "etimesgut": "etimesgut",
    "sincan": "sincan",
    "bornova": "bornova",
    "buca": "buca",
    "karsiyaka": "karsiyaka",
    "konak": "konak",
    "cigli": "cigli",
    "gokcebey": "gokcebey",
    "golbasi": "golbasi",
    "gölbasi": "golbasi",
    "golhisar": "golhisar",
}


def resolve_districts(rows: DataFrame, districts: DataFrame, block: str, fallback: bool = True) -> DataFrame:
    """row_id, district_id and level of each row's raw district name within its block.

    exact (slug), normalized (name), alias, fuzzy (Jaro-Winkler 0.85 or more, four letters at least), fallback (the
    central district, else the first), none. Districts have ord, their place in the block's list; the first one wins.
    """
    d = districts.select(block, "ord", F.col("id").alias("d_id"), F.col("slug"), text.district_name(F.col("name")).alias("d_name"))
    r = rows.select("row_id", block, F.trim(F.coalesce("raw", F.lit(""))).alias("raw"))
    r = r.withColumn("r_slug", text.slugify(F.col("raw"))).withColumn("r_name", text.district_name(F.col("raw")))
    some = F.col("raw") != ""
    first = lambda ok: F.min_by("d_id", F.when(ok, F.col("ord")))
    near = similarity.jaro_winkler(F.col("r_name"), F.col("d_name"))
    told = [block, "raw", "r_slug", "r_name", "r_alias", "r_other"]  # rows of the same name meet the districts once
    r = r.withColumn("r_alias", text.lookup(F.col("r_name"), DISTRICT_ALIASES, "")).withColumn("r_other", text.lookup(F.col("r_slug"), DISTRICT_ALIASES, ""))
    pairs = r.select(*told).distinct().join(d, block).withColumn("near", F.when(some & (F.length("r_name") >= 4), near).otherwise(0.0))
    central = (F.col("slug") == "merkez") | F.col("slug").endswith("-merkez") | (F.col("d_name") == "merkez")
    found = pairs.groupBy(*told).agg(
        first(some & (F.col("slug") == F.col("r_slug"))).alias("exact"),
        first(some & (F.col("d_name") == F.col("r_name"))).alias("normalized"),
        F.coalesce(*[first(some & (F.col(x) != "") & (F.col("slug") == F.col(x))) for x in ("r_alias", "r_other")]).alias("alias"),
        F.max_by("d_id", F.when(F.col("near") >= 0.85, F.struct("near", -F.col("ord")))).alias("fuzzy"),
        F.coalesce(first(central), first(F.lit(True))).alias("fallback"),
    )
    levels = ["exact", "normalized", "alias", "fuzzy", *(["fallback"] if fallback else [])]
    level = F.coalesce(*[F.when(F.col(x).isNotNull(), F.lit(x)) for x in levels], F.lit("none"))
    return r.select("row_id", *told).join(found, told, "left").select("row_id", F.coalesce(*levels).alias("district_id"), level.alias("level"))


def resolve_plain(rows: DataFrame, districts: DataFrame, block: str) -> DataFrame:
    """row_id and district_id by the older rules: slug, name, a slug that holds the other, the central district, the first."""
    d = districts.select(block, "ord", F.col("id").alias("d_id"), "slug", text.normalize_text(F.col("name")).alias("d_name"))
    r = rows.select("row_id", block, F.trim(F.coalesce("raw", F.lit(""))).alias("raw"))
    r = r.withColumn("needle", text.slugify(F.col("raw"))).withColumn("r_name", text.normalize_text(F.col("raw")))
    some = F.col("raw") != ""
    first = lambda ok: F.min_by("d_id", F.when(ok, F.col("ord")))
    part = F.contains(F.col("slug"), F.col("needle")) | F.contains(F.col("needle"), F.col("slug"))
    central = (F.col("slug") == "merkez") | F.col("slug").endswith("-merkez") | (F.col("d_name") == "merkez")
    # only the distinct names of a block meet its districts
    asked = r.select(block, "raw", "needle", "r_name").distinct()
    found = asked.join(d, block).groupBy(block, "raw").agg(F.coalesce(first(some & (F.col("slug") == F.col("needle"))), first(some & (F.col("d_name") == F.col("r_name"))), first(some & part), first(central), first(F.lit(True))).alias("district_id"))
    return r.select("row_id", block, "raw").join(found, [block, "raw"], "left").select("row_id", "district_id")
