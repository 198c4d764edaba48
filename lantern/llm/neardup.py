"""Similarity join of word shingles by a MinHash LSH forest.

Each trie of the forest holds the documents by a sequence of MinHash values of their shingle sets, its signature; the
documents below a node are those that share a prefix, a run of the sorted signatures. Candidates are what shares a prefix
in any trie. Matching begins at the longest prefixes; the prefixes are shortened value by value until the pairs found
reach the target recall, which is measured: while the signatures are made, each set is compared exactly with those of a
bounded sample of documents, and of each pair that is similar enough it is noted how long the longest prefix is that the
two share in any trie. So the depth at which the forest is cut follows from the similarities that the corpus has; pairs at
the least similarity are mixed in as if some had been seen, which decides where the sample has few pairs.

Candidates are verified by their exact Jaccard similarity, where a group of a prefix meets. Groups with the same members in
many tries are looked at once, large groups are dealt to many tasks as pairs of blocks of so many bytes, and a task returns
counts and a spanning forest of the links that it found, never the pairs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import map_batches, small_batches, spread, written
from lantern.llm.components import components

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
TRIES, DEEPEST = 16, 8
#: Documents whose similar partners are looked for among all documents, to measure the recall of each depth; those of the
#: smallest hashes. Pairs at the least similarity that count as seen besides.
SAMPLE, SUPPOSED = 512, 200
#: Bytes of the sets of a block; the pairs of two blocks meet in one task.
BLOCK = 2 << 20
#: Bytes up to which a table of candidates goes to all executors; a larger one is joined by shuffling.
BROADCAST = 8 << 20

_SEEDS = np.random.default_rng(5081).integers(1, 1 << 62, (3, max(TRIES * DEEPEST, 64)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Places of words in the table of their hashes.
_KNOWN: dict[str, int] = {}
_TABLE = np.zeros(1 << 19, np.uint64)


def expected(depth: int, tries: int = TRIES, similarity: float = SIMILARITY) -> float:
    """The share of the pairs of that similarity that have a prefix of that depth in common in one of the tries."""
    return 1 - (1 - similarity**depth) ** tries


def stop_depth(met: list[int], recall: float = RECALL, tries: int = TRIES, similarity: float = SIMILARITY, supposed: int = SUPPOSED) -> int:
    """The longest prefix at which the target recall is reached. met: how many pairs of the sample share at most a prefix of
    0, 1, 2 ... values."""
    for depth in range(len(met) - 1, 1, -1):
        if sum(met[depth:]) + supposed * expected(depth, tries, similarity) >= recall * (sum(met) + supposed):
            return depth
    return 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(word: str) -> int:
    """Puts a new word's hash into the table, after the others."""
    global _TABLE
    n = len(_KNOWN) + 1
    if n >= len(_TABLE):
        _TABLE = np.concatenate([_TABLE, np.zeros(len(_TABLE), np.uint64)])
    _TABLE[n] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1
    _KNOWN[word] = n
    return n


def flat_hashes(texts: list[list[str]]) -> np.ndarray:
    """64-bit hashes of the words of some texts, one after the other; those of words seen before are looked up."""
    if len(_KNOWN) > 300_000:
        _KNOWN.clear()
    known = _KNOWN.get
    place = np.array([known(x) or _place(x) for words in texts for x in words], np.int64)
    return _TABLE[place]  # which may be a longer one by now


def word_hashes(text: str | None) -> np.ndarray:
    """The same of one text, split at white space."""
    return flat_hashes([(text or "").split()])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of so many words (split at white space) of a text; a shorter text is one run."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(len(w) - words + 1, 1)
    h = np.full(n, len(w) if len(w) < words else words, np.uint64)
    for k in range(min(words, len(w))):
        h += w[k : k + n] * _SEEDS[2, k]
    return np.unique(_mixed(h))


def signature(s: np.ndarray, tries: int = TRIES, deepest: int = DEEPEST) -> np.ndarray:
    """The MinHash values (32 bits) of a set in each trie."""
    values = np.empty(tries * deepest, np.uint64)
    for k in range(0, len(values), 16):
        some = slice(k, k + 16)
        values[some] = (s[None, :] * _SEEDS[0, some][: len(values) - k, None] + _SEEDS[1, some][: len(values) - k, None]).min(axis=1)
    return (_mixed(values) >> np.uint64(32)).astype(np.uint32).reshape(tries, deepest)


class Sample:
    """The sets of some documents, to be compared with any other."""

    def __init__(self, texts: list[str | None], words: int, tries: int, deepest: int) -> None:
        sets = {s.tobytes(): s for s in (shingles(t, words) for t in texts) if len(s)}.values()
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.signatures = np.array([signature(s, tries, deepest) for s in sets])
        every = np.concatenate([*sets, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.hashes, self.begins = np.unique(every[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(every))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes & np.uint64((1 << 20) - 1)] = True

    def met(self, s: np.ndarray, own: np.ndarray, similarity: float, out: np.ndarray) -> None:
        """Adds the pairs of a set with those of the sample that are similar, but not the same, to their depth."""
        some = s[self.maybe[s & np.uint64((1 << 20) - 1)]]
        if not len(some) or not len(self.hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        at = at[self.hashes[at] == some]
        count = self.ends[at] - self.begins[at]
        places = np.repeat(self.begins[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(self.owners[places], minlength=len(self.sizes))
        near = np.flatnonzero((common >= similarity * (self.sizes + len(s) - common) - 1e-9) & ~((common == len(s)) & (common == self.sizes)))
        if len(near):
            depth = np.cumprod(self.signatures[near] == own[None], axis=2).sum(axis=2).max(axis=1)
            np.add.at(out, depth, 1)


def signatures(docs: DataFrame, sample: Sample, words: int = WORDS, tries: int = TRIES, deepest: int = DEEPEST, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, set_key (the same for the same set of shingles), size (of the set), tries (the signature in each,
    none if there is no word), and met (see stop_depth; null mostly)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, found, met = [], [], [], []
        for text in batch["text"].to_pylist():
            s = shingles(text, words)
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sizes.append(len(s))
            own = signature(s, tries, deepest) if len(s) else None
            found.append([row.astype(">u4").tobytes() for row in own] if len(s) else None)
            pairs = np.zeros(deepest + 1, np.int64)
            if len(s):
                sample.met(s, own, similarity, pairs)
            met.append(pairs.tolist() if pairs.any() else None)
        columns = [batch["doc_id"], batch["text_hash"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.binary())), pa.array(met, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "set_key", "size", "tries", "met"])

    return map_batches(docs, run, "doc_id long, text_hash long, set_key binary, size long, tries array<binary>, met array<long>")


def _overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set but the last, its number, and how many elements it has in common with each of the later sets."""
    if len(sets) == 2:
        yield 0, np.array([0, len(np.intersect1d(*sets, assume_unique=True))])
        return
    sizes = np.array([len(s) for s in sets])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(inverse, kind="stable")]
    ends = np.cumsum(np.bincount(inverse))
    begins, at = ends - np.bincount(inverse), 0
    for i, size in enumerate(sizes[:-1]):
        mine = inverse[at : at + size]
        at += size
        count = ends[mine] - begins[mine]
        places = np.repeat(begins[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        yield i, np.bincount(owners[places], minlength=len(sets))


def verify(reps: list[int], sets: list[np.ndarray], groups: list[list[int]], blocks: list[int], across: bool, group: int, similarity: float) -> Iterator[tuple[int, int, int]]:
    """(document, its root, its links): the links of a group's documents, each pair in the first group that it shares
    only. across: of two blocks, one of which may be empty, only the pairs across."""
    n, sizes = len(reps), np.array([len(s) for s in sets])
    links, root = [0] * n, list(range(n))
    shared = [frozenset(g) for g in groups]
    block = np.array(blocks)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, common in _overlaps(sets):
        near = common >= similarity * (sizes + sizes[i] - common) - 1e-9
        near[: i + 1] = False
        if across:
            near &= block != block[i]
        for j in np.flatnonzero(near).tolist():
            if len(shared[i]) == 1 or len(shared[j]) == 1 or min(shared[i] & shared[j]) == group:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                if a != b:
                    a, b = (a, b) if reps[a] < reps[b] else (b, a)
                    root[b] = a
    for i in range(n):
        if links[i]:
            yield reps[i], reps[find(i)], links[i]


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).where("doc_id is not null")


def _signed(docs: DataFrame, words: int, similarity: float, tries: int, deepest: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """The signatures as a table, and of each id the text that counts: that of the least hash, and how many rows it has."""
    small_batches(docs.sparkSession)
    source = _source(docs)
    least = source.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = source.join(F.broadcast(least), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    compared = Sample([r["text"] for r in chosen], words, tries, deepest)
    signed = written(signatures(spread(source), compared, words, tries, deepest, similarity), "signatures")
    return signed, signed.groupBy("doc_id").agg(F.min(F.struct("text_hash", "set_key")).alias("m"), F.count("*").alias("n_rows")).select("doc_id", "m.*", "n_rows")


def similarity_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, tries: int = TRIES, deepest: int = DEEPEST, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row for each doc_id: class_id, rep_id, n_copies and n_links.

    rep_id is the smallest id with the same set of shingles and n_copies the number of ids with it; n_links counts the
    other sets whose Jaccard similarity is high enough, as verified exactly; class_id is the smallest id that is reached
    over links and copies. Texts without words (null, empty, white space) are copies of each other and have no links.
    Rows with a null id take no part; an id that is repeated counts once (with the text of the smallest xxhash64). Other
    columns are ignored. No group is capped. sample bounds the documents by which the recall is measured.
    """
    return _joined(docs, *_signed(docs, words, similarity, tries, deepest, sample), words, similarity, recall, tries, deepest, block)


def _joined(docs: DataFrame, signed: DataFrame, ids: DataFrame, words: int, similarity: float, recall: float, tries: int, deepest: int, block: int) -> DataFrame:
    met = signed.where("met is not null").select(F.posexplode("met").alias("depth", "n")).groupBy("depth").agg(F.sum("n").alias("n")).collect()
    found = dict(met)
    depth = stop_depth([found.get(d, 0) for d in range(deepest + 1)], recall, tries, similarity)
    classes = ids.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    reps = signed.select("doc_id", "set_key", "size", "tries").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_key"])
    reps = written(reps.dropDuplicates(["doc_id", "set_key"]).select("set_key", F.col("doc_id").alias("rep"), "n_copies", "size", "tries"), "reps")
    prefix = F.substring("signature", 1, 4 * depth)
    nodes = reps.select("rep", F.col("set_key").alias("key"), "size", F.posexplode("tries").alias("trie", "signature")).withColumn("group", F.xxhash64("trie", prefix))
    mixed = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")]
    of = nodes.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *mixed).where("n > 1")
    once = of.groupBy("n", "x", "y").agg(F.min("group").alias("group"), F.first("total").alias("total"))
    once = once.select("group", F.ceil(8 * F.col("total") / block).cast("int").alias("blocks"))
    members = written(nodes.select("rep", "key", "group").join(once, "group").groupBy("rep", "key").agg(F.collect_list(F.struct("group", "blocks")).alias("groups")), "members")
    held_bytes = members.agg(F.sum(64 + 24 * F.size("groups"))).first()[0] or 0
    source = _source(docs)
    texts = source.join(F.broadcast(members) if held_bytes <= BROADCAST else members, source["doc_id"] == members["rep"])

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, words) for t in batch["text"].to_pylist()]
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
        held = pa.array([s.tobytes() for s in found], pa.binary())
        return pa.RecordBatch.from_arrays([batch["rep"], pc.equal(batch["key"], pa.array(keys, pa.binary())), held, batch["groups"]], ["rep", "own_text", "held", "groups"])

    kind = "rep long, own_text boolean, held binary, groups array<struct<group:long,blocks:int>>"
    candidates = map_batches(texts.select("rep", "key", "text", "groups"), sets, kind).where("own_text")
    candidates = candidates.select("rep", "held", F.col("groups.group").alias("mine"), F.explode("groups").alias("g")).select("rep", "held", "mine", "g.*")
    candidates = candidates.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    candidates = candidates.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    candidates = candidates.select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "held", "mine", "own")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for (group, low, high), some in itertools.groupby(rows, lambda r: (r["group"], r["low"], r["high"])):
            unique = {r["rep"]: r for r in some}  # a repeated id came more than once
            if len(unique) > 1:
                at = list(unique.values())
                held = [np.frombuffer(r["held"], np.uint64) for r in at]
                found = list(verify([r["rep"] for r in at], held, [r["mine"] for r in at], [r["own"] for r in at], low != high, group, similarity))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["rep", "root", "links"])

    dealt = candidates.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "rep")
    linked = written(dealt.mapInArrow(links, "rep long, root long, links long"), "links")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("n_links"))
    parts = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = reps.select("set_key", "rep", "n_copies").join(counts, "rep", "left").join(parts, "rep", "left")
    return ids.join(known, "set_key").select(
        "doc_id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("rep_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, tries: int = TRIES, deepest: int = DEEPEST, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """The documents whose id is the class_id of similarity_join: one of each group of near copies, with all columns.

    Of a repeated id only a row with the text that counts for it can stay, and one of these if there are several; which,
    if they differ in other columns, isn't defined. Rows with a null id go. Null, empty and blank texts are one group.
    """
    signed, ids = _signed(docs, words, similarity, tries, deepest, sample)
    kept = _joined(docs, signed, ids, words, similarity, recall, tries, deepest, block).where("doc_id = class_id").select("doc_id")
    kept = kept.join(ids, "doc_id").select(F.col("doc_id").alias("_neardup_id"), F.col("text_hash").alias("_neardup_text"))
    out = docs.join(kept, (F.col("doc_id").cast("long") == F.col("_neardup_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_neardup_text"))).drop("_neardup_id", "_neardup_text")
    return out if ids.where("n_rows > 1").isEmpty() else out.dropDuplicates(["doc_id"])
