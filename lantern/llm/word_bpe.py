"""BPE with word ends by a pair occurrence index.

The new words of a run of texts are laid out side by side as symbols. An index maps each pair that a merge names to all its
positions. Its active ranks are applied in ascending order, each at all positions of its pair from left to right; a merge
takes two pairs away and makes two, whose lists are updated at once. Positions whose pair has gone are told when they come up.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import map_batches, small_batches, spread

#: Words, and chunks between spaces, that a Python worker remembers, and characters of texts whose words are merged in one index.
MAX_WORDS, RUN_CHARS = 500_000, 4_000_000
#: Symbols up to which an index holds them in lists.
LISTED = 4_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of this family: printable ones for themselves, the others from
    U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PairIndex:
    """Symbols of many words, and for each rank the positions of its pair."""

    def __init__(self, pairs: dict[int, int], merges: list[tuple[int, int, int]], first: np.ndarray, words: list[np.ndarray]) -> None:
        """first: the rank of each pair of the symbols that words are laid out in, or -1."""
        self.pairs, self.merges = pairs, merges
        border = np.array([-1], np.int32)  # no pair goes over the end of a word
        symbols = np.concatenate([border, *(part for word in words for part in (word, border))])
        self.starts = np.flatnonzero(symbols[:-1] < 0) + 1
        ranks = np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), first[symbols[:-1], symbols[1:]], -1)
        spots = np.flatnonzero(ranks >= 0)
        spots = spots[np.argsort(ranks[spots], kind="stable")]
        active, begin = np.unique(ranks[spots], return_index=True)
        self.positions = {rank: part.tolist() for rank, part in zip(active.tolist(), np.split(spots, begin[1:]), strict=False)}
        kept = list if len(symbols) < LISTED else partial(array, "i")  # lists are quicker, arrays smaller
        self.symbols, self.after, self.before = kept(symbols.tolist()), kept(range(1, len(symbols) + 1)), kept(range(-1, len(symbols) - 1))

    def merge(self) -> None:
        symbols, after, before, positions, rank_of = self.symbols, self.after, self.before, self.positions, self.pairs.get
        active = list(positions)
        heapify(active)
        while active:
            rank = heappop(active)
            left, right, made = self.merges[rank]
            spots = sorted(positions.pop(rank))
            for k, at in enumerate(spots):
                second = after[at]
                if symbols[at] != left or symbols[second] != right:
                    continue  # the pair has gone
                symbols[at], symbols[second] = made, -1
                third, first = after[second], before[at]
                after[at], before[third] = third, at
                for place, pair in ((first, symbols[first] << 32 | made), (at, made << 32 | symbols[third])):
                    come = rank_of(pair)  # none at the end of a word: such a pair is negative
                    if come is None:
                        continue
                    if come in positions:
                        positions[come].append(place)
                    else:
                        positions[come] = [place]
                        heappush(active, come)
                if active and active[0] < rank:  # a pair of an earlier rank has come up: the rest waits
                    if rank not in positions:
                        positions[rank] = []
                        heappush(active, rank)
                    positions[rank] += spots[k + 1 :]
                    break

    def words(self) -> Iterator[list[int]]:
        symbols, after = self.symbols, self.after
        for at in self.starts.tolist():
            out = []
            while symbols[at] >= 0:
                out.append(symbols[at])
                at = after[at]
            yield out


class Encoder:
    """Reads the vocabulary file of a tokenizer with these parts: NFC, replacement, lower case; a pattern whose matches are
    words; letters for bytes; BPE with an end of word; special tokens, which are looked for first in the text as it is.
    White space must end every word of the pattern. Characters newer than Unicode 15.1 may be cut or lowered in another way
    than by the library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, (split, letters) = told["model"], told["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or (split["type"], split["behavior"], split["invert"], letters["type"], letters["use_regex"], letters["add_prefix_space"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError(f"{path} has other parts than this encoder knows")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.steps = [self._step(x) for x in told["normalizer"]["normalizers"]]
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.special = special
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, sorted(special, key=len, reverse=True)))})").split if special else lambda text: [text]
        self.inner, self.last = (np.array([vocabulary[x + y] for x in byte_letters()], np.int32) for y in ("", end))
        self.tokens = {i: token for token, i in (vocabulary | special).items()}
        self.merges: list[tuple[int, int, int]] = []
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.append((vocabulary[a], vocabulary[b], vocabulary[a + b]))
            self.pairs[vocabulary[a] << 32 | vocabulary[b]] = rank
        size = 1 + max(self.inner.max(), self.last.max())
        self.first = np.array([[self.pairs.get(a << 32 | b, -1) for b in range(size)] for a in range(size)], np.int32)
        self.special_ids = {i: struct.pack("<I", i) for i in special.values()}
        self.known: dict[str | int, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _step(told: dict):
        if told["type"] == "NFC":
            return lambda text: text if text.isascii() else unicodedata.normalize("NFC", text)
        if told["type"] == "Replace" and told["pattern"]["Regex"] == r"\s+":
            return lambda text: text  # white space ends all words of the pattern, so its runs needn't be made one
        if told["type"] == "Replace":
            return lambda text, sub=regex.compile(told["pattern"]["Regex"]).sub, by=told["content"]: sub(by, text)
        if told["type"] == "Lowercase":  # each letter for itself: a last sigma is lowered like any other
            return lambda text: text.replace("Σ", "σ").lower()
        raise ValueError(f"unknown step {told['type']}")

    def _chunks(self, text: str) -> list[str | int]:
        """The text between spaces, in the normal form; special tokens as their ids."""
        out: list[str | int] = []
        for k, part in enumerate(self.cut(text) if any(x in text for x in self.special) else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                for step in self.steps:
                    part = step(part)
                out += part.split(" ")
        return out

    def _merge(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        laid = []
        for word in new:
            data = np.frombuffer(word.encode("utf-8"), np.uint8)
            laid.append(self.inner[data])
            laid[-1][-1] = self.last[data[-1]]
        index = PairIndex(self.pairs, self.merges, self.first, laid)
        index.merge()
        for word, ids in zip(new, index.words(), strict=True):
            yield word, struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        run, size = [], 0
        for text in texts:
            run.append(self._chunks(text))
            size += len(text)
            if size >= RUN_CHARS:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, texts: list[list[str | int]]) -> Iterator[bytes]:
        known, words = self.known, self.words
        for kept in (known, words):
            if len(kept) > MAX_WORDS:
                for key in [*kept][: MAX_WORDS // 2]:
                    del kept[key]
        known |= self.special_ids
        split = {chunk: self.split(chunk) for chunk in set().union(*texts).difference(known)}
        if new := list(set().union(*split.values()).difference(words)):
            words.update(self._merge(new))
        known.update((chunk, b"".join([words[word] for word in parts])) for chunk, parts in split.items())
        for chunks in texts:
            yield b"".join([known[chunk] for chunk in chunks])
        for kept, fresh in ((known, split), (words, new)):
            for key in fresh:
                if len(key) > 64:  # not worth remembering
                    del kept[key]

    def decode(self, ids: bytes) -> Iterator[str]:
        """The tokens with spaces between, in chunks; special tokens stay."""
        for at in range(0, len(ids), 1 << 16):
            part = ids[at : at + (1 << 16)]
            yield (" " if at else "") + " ".join([self.tokens[i] for i in struct.unpack(f"<{len(part) // 4}I", part)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _source(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token_ids of every whole text. A null text counts as empty and has no ids; rows with a null or repeated
    doc_id stay as they are; other columns are ignored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [array("I", x).tolist() for x in encoder(path).encode([t or "" for t in batch["text"].to_pylist()])]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return map_batches(_source(docs), run, "doc_id long, token_ids array<int>")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text, the tokens with spaces between, from doc_id and token_ids; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["".join(encoder(path).decode(struct.pack(f"<{len(ids or [])}I", *(ids or [])))) for ids in batch["token_ids"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    small_batches(tokens.sparkSession)
    return map_batches(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids"), run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text and keeps digests of both ways: doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded text in UTF-8). Nulls and repeats as in
    encode_documents; an empty text has the digests of nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e, counts, digests, back = encoder(path), [], [], []
        for ids in e.encode([t or "" for t in batch["text"].to_pylist()]):
            counts.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            whole = hashlib.sha256()
            for part in e.decode(ids):
                whole.update(part.encode("utf-8"))
            back.append(whole.hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(_source(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
