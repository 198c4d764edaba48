import random
import time

import numpy as np
import pyarrow as pa
import pytest
from numpy import log

from lantern.llm import lm

WHITE = [chr(k) for k in range(0x3001) if chr(k).isspace()]


def hashes_of(texts: list[str | None]) -> dict[str, int]:
    """Words of Python's split with their hashes, all checked to be the same word by word."""
    words = [(t or "").split() for t in texts]
    keys, sizes = lm.word_keys(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(w) for w in words] and len(keys) == sizes.sum()
    found = {}
    for word, key in zip((x for w in words for x in w), keys.tolist(), strict=True):
        assert found.setdefault(word, key) == key
    assert len(set(found.values())) == len(found)
    return found


def test_words_are_those_of_split():
    """Also with white space of several bytes, letters whose bytes begin like it, zero bytes, and words that meet at texts' ends."""
    rng = random.Random(5)
    letters = WHITE + list("ab\x00\x01\u0081é¡​‐‪、中\U0001f600")
    for _ in range(300):
        hashes_of([None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.choice([0, 1, 3, 40]))) for _ in range(rng.randrange(6))])
    hashes_of(["".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)])


def test_words_are_told_apart_at_all_lengths():
    ends = ["", "\x00", "\x00\x00", "b"]
    hashes_of([" ".join("a" * n + e for n in range(1, 300) for e in ends), "a" * 50_000, "a" * 50_001])


def test_a_part_of_a_column():
    texts = pa.array(["x y", "b c d", None, "y"])
    keys, sizes = lm.word_keys(texts[1:])
    assert sizes.tolist() == [3, 0, 1] and keys[-1] == lm.word_keys(texts)[0][1]


def test_more_new_words_than_a_table_of_words_holds(spark):
    """A text with 600,000 distinct words, none of them seen before."""
    n = 600_000
    docs = spark.createDataFrame([(1, " ".join(f"{k:x}" for k in range(n)))], "doc_id long, text string")
    row = lm.score(docs).first()
    assert row["n_tokens"] == n and row["log_score"] == pytest.approx(log(1 / n))


def test_new_words_cost_little():
    """In CPU time beside Python's split of the same texts: two to three times it; 29 times it when each new word was a Python
    string with a hash of its own."""
    split = gathered = 0.0
    for seed in range(3):
        rng = np.random.default_rng(seed)
        texts = [" ".join(f"{k:x}" for k in rng.integers(0, 1 << 40, 1000)) for _ in range(200)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        at = time.process_time()
        words = [t.split() for t in texts]
        split += time.process_time() - at
        at = time.process_time()
        (_, runs), = lm._gathered(iter([batch]))
        gathered += time.process_time() - at
        assert len(runs.words) == sum(map(len, words)) == 200_000
    assert gathered < 8 * split


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_places_of_frequent_runs(n):
    """Among keys that have their first bits in common too."""
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64), rng.integers((1 << 64) - 4 * n - 1, 1 << 64, n, np.uint64)]))
    known = lm.Frequent(keys, np.ones(len(keys)), total=9, least=1, backoff=0.4)
    near = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), rng.integers(0, 1 << 64, 2000, np.uint64)])
    where = {k: i for i, k in enumerate(keys.tolist())}
    assert known.places(near).tolist() == [where.get(k, lm.RARE) for k in near.tolist()]
