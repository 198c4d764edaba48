"""Quality by weak labels.

Heuristic labellers look at shares of kinds of words in a text: repeated, all capitals, ending in exclamation or symbols,
without letters, and others. Expectation maximisation over the patterns of their votes on all documents estimates their
accuracies, and the posterior labels of a bounded sample train a linear scorer over hashed word shapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import map_batches, small_batches, spread
from lantern.llm.toxicity import keep_scored
from lantern.llm.weak import LabelModel, Linear, fit_label_model, fit_linear, hashed

#: Documents that the scorer is trained on, at most; those of the smallest hashes.
SAMPLE = 12_000
DIM = 1 << 14
#: What a shape tells: all capitals, ends in exclamation marks, ends in odd symbols, has no letter or digit, ends a sentence, has a digit.
TRAITS = 6
LABELLERS = ("repeats", "variety", "capitals", "exclamation", "symbols", "no letters", "sentences", "digits")
LEAST = 30


def shape(word: str) -> tuple[str, tuple[int, ...]]:
    """A word's case, length and ending as a feature, and its traits."""
    body = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…»”’")
    end = word[len(body) :][-3:]
    letters = any(c.isalnum() for c in body)
    case = "none" if not letters else "upper" if body.isupper() and len(body) > 1 else "title" if body[:1].isupper() else "lower" if body.islower() else "other"
    size = "1" if len(body) < 2 else "3" if len(body) < 4 else "7" if len(body) < 8 else "12" if len(body) < 13 else "long" if len(body) < 30 else "huge"
    odd = len(end) > 1 and not set(end) <= set("\"').,!?…»”’") and letters
    traits = (case == "upper", end.endswith("!!"), odd, not letters, end[-1:] in (".", "!", "?") and len(end) == 1, any(c.isdigit() for c in body))
    return f"{case} {size} {end}", tuple(map(int, traits))


class Shapes:
    """Counts of shapes in texts; remembers the shapes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers: dict[str, int] = {}
        self.indices: list[int] = []
        self.traits = np.zeros((0, TRAITS))

    def _of(self, word: str) -> int:
        name, traits = shape(word)
        n = self.numbers.get(name)
        if n is None:
            n = self.numbers[name] = len(self.numbers)
            self.indices.append(hashed(name, DIM))
            self.traits = np.vstack([self.traits, [traits]])
        if len(self.known) >= 300_000:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = n
        return n

    def count(self, text: str | None) -> tuple[int, float, float, np.ndarray]:
        """Words, share of words equal to the one before, distinct words of those after at most 200 each, and shapes."""
        words = (text or "").split()
        if not words:
            return 0, 0.0, 1.0, np.zeros(len(self.numbers))
        known = self.known.get
        ids = [n if (n := known(w)) is not None else self._of(w) for w in words]
        repeats = sum(map(str.__eq__, words, words[1:])) / len(words)
        runs = [words[at : at + 200] for at in range(0, len(words), 200)]
        variety = sum(len(set(r)) for r in runs) / len(words)
        return len(words), repeats, variety, np.bincount(ids, minlength=len(self.numbers))

    def votes(self, text: str | None) -> list[int]:
        """Of each labeller: 1 good, 0 bad, -1 none."""
        n, repeats, variety, counts = self.count(text)
        if n < LEAST:
            n, few = max(n, 1), True
        else:
            few = False
        upper, loud, odd, bare, ends, digits = (counts @ self.traits[: len(counts)]) / n

        def between(x: float, good: float, bad: float) -> int:
            return 1 if x <= good else 0 if x >= bad else -1

        return [
            between(repeats, 0.05, 0.3),
            -1 if few else between(1 - variety, 0.6, 0.8),
            between(upper, 0.1, 0.4),
            between(loud, 0.02, 0.3),
            between(odd, 0.02, 0.3),
            between(bare, 0.05, 0.3),
            -1 if few else (1 if 0.002 <= ends <= 0.5 else -1),
            between(digits, 0.1, 0.5),
        ]

    def entries(self, text: str | None) -> tuple[list[int], list[float]]:
        """Hashed features and their values: shares of shapes, of repeats and of variety."""
        n, repeats, variety, counts = self.count(text)
        at = np.flatnonzero(counts).tolist()
        indices = [self.indices[k] for k in at] + [hashed("repeats", DIM), hashed("same", DIM)]
        return indices, [*(5 * counts[at] / max(n, 1)).tolist(), 5 * repeats, 5 * (1 - variety)]


class Scorer(Shapes):
    def __init__(self, model: Linear) -> None:
        super().__init__()
        self.model = model

    def score(self, text: str | None) -> float:
        return self.model.score(*self.entries(text))


def fit_votes(docs: DataFrame) -> LabelModel:
    """The label model of the votes on all documents; only the counts of the patterns reach the driver, at most three to
    the power of the labellers."""
    made: list[Shapes] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Shapes())
        return pa.RecordBatch.from_arrays([pa.array([made[0].votes(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))], ["votes"])

    rows = map_batches(docs.select("text"), run, "votes array<int>").groupBy("votes").count().collect()
    votes = np.array([r["votes"] for r in rows], dtype=np.int64).reshape(-1, len(LABELLERS))
    return label_model(votes, np.array([r["count"] for r in rows]))


def label_model(votes: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Class 0 is good; there is a class of bad texts for each labeller, as a text is mostly bad in one or two ways, and
    the labellers of the other ways then call it good."""
    bad = (votes == 0).astype(float)
    first = np.column_stack([bad.sum(1) == 0, bad / np.maximum(bad.sum(1, keepdims=True), 1)])
    return fit_label_model(votes, counts, 0.98 * first + 0.02 / first.shape[1], silence=False)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Linear:
    """The scorer. From an empty table it takes every text as good. Of a repeated id the smallest text is in the sample."""
    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    model = fit_votes(source)
    chosen = source.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    made: list[Shapes] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Shapes())
        texts = batch["text"].to_pylist()
        found = [made[0].entries(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array([made[0].votes(t) for t in texts], pa.list_(pa.int32())), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
            ["votes", "at", "values"],
        )

    rows = map_batches(source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text"), run, "votes array<int>, at array<int>, values array<double>").collect()
    if not rows:
        return Linear({}, 4.0)
    target = model.posterior(np.array([r["votes"] for r in rows]))[:, 0]
    lines = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    return fit_linear(lines, np.concatenate([r["at"] for r in rows]), np.concatenate([r["values"] for r in rows]), target)


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and predicted (1 if the score is 0.5 or more) of every document, repeated
    ones too. A null text is scored as an empty one, which no labeller calls bad. Other columns are ignored."""
    small_batches(docs.sparkSession)
    model = fit(docs, sample)
    made: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scorer(model))
        score = np.array([made[0].score(t) for t in batch["text"].to_pylist()])
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return map_batches(source, run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents of good quality, with all columns; repeated rows and null ids stay as they are, and a null text counts
    as an empty one, which stays."""
    small_batches(docs.sparkSession)
    return keep_scored(docs, Scorer, fit(docs, sample), lambda s: s >= 0.5)
