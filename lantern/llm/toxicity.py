"""Toxicity by weak supervision.

Voters: a fixed lexicon, lexicons of words and of word beginnings that the labelled rows show to go with toxic texts, and
patterns. The labels only pick these lexicons. A generative model estimates the voters' accuracies and correlations from
their votes; its posterior labels train a linear classifier over hashed words and word beginnings. A score depends on the
whole text only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import map_batches, small_batches, spread, written
from lantern.llm.weak import LabelModel, Linear, fit_label_model, fit_linear, hashed

#: Labelled rows that the model is fitted on, at most; those of the smallest hashes.
SAMPLE = 12_000
DIM = 1 << 20
WORD = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6)
#: The share of toxic texts from which a learnt feature stands in a lexicon.
SURE = 0.9
#: Plain insults in English.
LEXICON = "idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb imbecile bastard bitch asshole fuck fucking shit whore slut retard vermin filth".split()
MASKED = re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]*\b", re.I)
SECOND = re.compile(r"\b(?:you|your|youre|u)\b\W+(?:\w+\W+){0,3}?(?:" + "|".join(LEXICON) + r")\b", re.I)
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def parts(word: str) -> list[str]:
    """A word, and its beginnings that are shorter than it, which end in a hyphen."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if len(word) > n]]


def features(words: set[str]) -> dict[str, int]:
    """The words of a text and their beginnings, a beginning of two words or of three and more again under a name of its
    own, and the size of the text (a power of two of distinct words)."""
    counts = Counter([w[:n] + "-" for n in BEGINNINGS for w in words if len(w) > n])
    found = dict.fromkeys(words, 1)
    for f, n in counts.items():
        found[f] = 1
        if n > 1:
            found[f"{f}2"] = 1
            if n > 2:
                found[f"{f}3"] = 1
    return found


def size_of(words: set[str]) -> str:
    return f"size {len(words).bit_length()}"


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def vote(text: str, known: dict[str, int], lexicons: int) -> list[int]:
    """Votes for one text: 1 toxic, 0 not, -1 none."""
    words = words_of(text)
    hits = [0] * lexicons
    for f in features(words):
        k = known.get(f)
        if k is not None:
            hits[k] += 1
    base = sum(w in words for w in LEXICON)
    out = [1 if base else -1, *(1 if h else -1 for h in hits)]
    out += [1 if MASKED.search(text) else -1, 1 if SECOND.search(text) else -1, 1 if base + sum(hits) > 2 else -1, -1 if base + sum(hits) else 0]
    return out


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Text and label of a bounded sample of the labelled rows that aren't held out."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.where(~F.expr(HELD_OUT)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    return written(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "training")  # of a repeated id one row, so the bound holds


def learn_features(training: DataFrame) -> dict[str, float]:
    """Features that go with toxic texts beyond chance: texts that have it times the divergence of their share of toxic
    ones from that of all texts exceeds the logarithm of the number of features tried. Each with its share of toxic texts;
    all that pass are kept, so the bound of the training rows bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, t = Counter(), Counter()
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = features(words_of(text))
                n.update(found)
                if toxic:
                    t.update(found)
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([t[k] for k in keys], pa.int64())], ["feature", "n", "t"])

    total = training.agg(F.avg("toxic").alias("rate")).first()["rate"]
    if not total or total >= 1:
        return {}
    counted = training.select("text", "toxic").mapInArrow(run, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counted = written(counted, "features")
    p = F.col("t") / F.col("n")
    gain = p * F.log(p / total) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - total))).otherwise(0.0)
    tried = counted.withColumn("gain", F.when(p > total, F.col("n") * gain).otherwise(0.0))
    kept = tried.where(F.col("gain") > float(np.log(max(counted.count(), 2))))
    return {r["feature"]: r["p"] for r in kept.select("feature", p.alias("p")).collect()}


def label_model(votes: np.ndarray) -> LabelModel:
    """The generative model of the voters: their chances in each class and their correlations follow from their votes alone,
    beginning with what two voters or more, or a sure one, call toxic. The given labels aren't among the voters."""
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    hits = (patterns == 1).sum(axis=1, keepdims=True)
    first = np.where(hits > 1, [[0.1, 0.9]], np.where(hits == 1, [[0.4, 0.6]], [[0.95, 0.05]]))
    return fit_label_model(patterns, np.bincount(at.ravel()), first, silence=True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Linear:
    """The classifier. Without a toxic label it only knows the fixed lexicon."""
    training = _training(docs, labels, sample)
    learnt = learn_features(training)
    fixed = {hashed(w, DIM): 4.0 for w in LEXICON}
    if not learnt:
        return Linear(fixed, -2.0)
    # lexicons: what is nearly always toxic; words by a hash to three voters, beginnings by their length
    beginning = re.compile(r"(.+)-[23]?")
    groups = {f: BEGINNINGS.index(len(m[1])) + 3 if (m := beginning.fullmatch(f)) else zlib.crc32(f.encode()) % 3 for f, p in learnt.items() if p >= SURE}
    lexicons = 3 + len(BEGINNINGS)
    named = {**dict.fromkeys(learnt), **dict.fromkeys(LEXICON)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes, found = [], []
        for text in batch["text"].to_pylist():
            votes.append(vote(text or "", groups, lexicons))
            words = words_of(text)
            found.append(sorted({hashed(f, DIM) for f in [*features(words), size_of(words)] if f in named or f.startswith("size ")}))
        return pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], ["votes", "found"])

    rows = map_batches(training.select("text"), run, "votes array<int>, found array<long>").collect()
    votes = np.array([r["votes"] for r in rows])
    model = label_model(votes)
    target = model.posterior(votes)[:, 1]
    lines = np.repeat(np.arange(len(rows)), [len(r["found"]) for r in rows])
    columns = np.array([i for r in rows for i in r["found"]], np.int64)
    linear = fit_linear(lines, columns, np.ones(len(columns)), target)
    for w in LEXICON:  # words of the lexicon that no training row has
        linear.weights.setdefault(hashed(w, DIM), 4.0)
    return linear


class Scorer:
    """Scores texts; remembers the weighted features of words. names: the learnt features."""

    def __init__(self, model: Linear) -> None:
        self.weights = model.weights
        self.bias = model.bias
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in parts(word) if any(hashed(f + n, DIM) in self.weights for n in ("", "2", "3")))
        if len(self.known) >= 300_000:
            self.known.clear()
        self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        words, known, counts = words_of(text), self.known.get, {}
        for w in words:
            f = known(w)
            if f is None:
                f = self._of(w)
            for x in f:
                counts[x] = counts.get(x, 0) + 1
        found = {hashed(size_of(words), DIM)}
        for f, n in counts.items():
            found.add(hashed(f, DIM))
            if f.endswith("-"):
                found.update(hashed(f"{f}{k}", DIM) for k in range(2, min(n, 3) + 1))
        x = self.bias + sum(self.weights.get(i, 0.0) for i in found)
        return float(1 / (1 + np.exp(-min(max(x, -500), 500))))


def score_documents(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, repeated ones too.

    A null text is scored as an empty one; held_out is null for a null id. Other columns are ignored.
    """
    scorers: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scorers:
            scorers.append(Scorer(model))
        score = np.array([scorers[0].score(t) for t in batch["text"].to_pylist()])
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    scored = map_batches(source, run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, as score_documents has them, by a classifier fitted here.

    Labels that are null or neither 0 nor 1 are ignored; an id with both counts as toxic; of a repeated id the smallest
    text is fitted on. Without a toxic label only the fixed lexicon is known. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    return score_documents(docs, fit(docs, labels, sample))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that aren't toxic, with all columns; no join, so repeated rows and null ids stay as they are, and a
    null text counts as an empty one."""
    small_batches(docs.sparkSession)
    return keep_scored(docs, Scorer, fit(docs, labels, sample), lambda s: s < 0.5)


def keep_scored(docs: DataFrame, scorer: type, model: Linear, keeps) -> DataFrame:
    """Rows of docs whose text's score keeps()."""
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not made:
                made.append(scorer(model))
            yield batch.filter(pa.array([keeps(made[0].score(t)) for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
