"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly if each two neighbours are the encoding of their own bytes. So
every prefix of a text has one encoding, and its last token is the only token that ends there and fits the last token of
the prefix before it. The transducer reads bytes; its non-deterministic control stands in the trie of tokens at once for
every place where a token may have begun. Determinised by subsets, that control is one state: the longest suffix of the
input that begins a token. Its moves, with the tokens that end after each, are made when a text first needs them. The
registers are the last tokens of the prefixes within reach. A token is emitted as soon as the encodings of all places in
reach share it, so the lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import map_batches, small_batches, spread

#: Moves, pieces and pairs of tokens kept by each Python worker; beyond them a cache starts again.
MAX_MOVES, MAX_PIECES, MAX_PAIRS = 300_000, 400_000, 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Bytes in, token ids out. All single bytes must be tokens."""

    #: Bytes of a long piece after which the tokens that nothing can change any more are emitted.
    STEP = 4096

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.width = 1 + max(ranks.values())
        self.parts_of: dict[int, tuple[int, int]] = {}
        self.begins: dict[bytes, int] = {b"": 0}  # what begins a token, and its state
        self.ends: dict[bytes, int] = {}  # tokens that merges can make
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merged(token)
                if len(parts) > 2:
                    continue  # no sequence of merges makes it, so it can't stand inside a longer piece
                self.parts_of[rank] = (ranks[parts[0]], ranks[parts[1]])
            self.ends[token] = rank
            for size in range(1, len(token) + 1):
                self.begins.setdefault(token[:size], len(self.begins))
        self.suffix = list(self.begins)
        self.moves: dict[int, tuple[int, list]] = {}
        self.pairs: dict[int, bool] = {}

    def _merged(self, piece: bytes) -> list[bytes]:
        """The definition: merges the neighbours of lowest rank, leftmost first, down to two parts at most."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether two tokens in a row stay as they are: undoes their merges, latest first, and looks whether a merge
        across the border would have come before the one undone (at equal rank the one further left comes first)."""
        ranks, bytes_of, parts_of = self.ranks, self.bytes_of, self.parts_of
        bound = 1 << 60
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], bound) < bound:
                return False
            undo_left, undo_right = parts_of.get(left), parts_of.get(right)
            if undo_left and (left > right or not undo_right):
                bound, left = left, undo_left[1]
            elif undo_right:
                bound, right = right + 1, undo_right[0]
            else:
                return True

    def _move(self, state: int, byte: int) -> tuple[int, list]:
        """Makes the move of a state under a byte: the next state, and (size, token) of what may end there."""
        suffix = self.suffix[state] + bytes((byte,))
        while suffix not in self.begins:
            suffix = suffix[1:]
        ends = [(len(suffix) - i, self.ends[suffix[i:]]) for i in range(len(suffix)) if suffix[i:] in self.ends]
        if len(self.moves) >= MAX_MOVES:
            self.moves.clear()
        move = self.moves[state << 8 | byte] = (self.begins[suffix], ends)
        return move

    def _fitting(self, left: int, token: int) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left * self.width + token] = self._fits(left, token)
        return fits

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens of the prefix that ends at a place."""
        out = []
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def _settled(self, last: list[int], state: int) -> int:
        """The furthest place through which the encodings of all places in reach go."""
        at = len(last) - 1
        live = set(range(at - len(self.suffix[state]), at + 1))
        while len(live) > 1:
            live.remove(at := max(live))
            live.add(at - len(self.bytes_of[last[at]]))
        return live.pop()

    def _other(self, ends: list[tuple[int, int]], last: list[int]) -> int:
        """The token that ends here where the first isn't it; it goes to the front, as it is likely the next time too."""
        for k, (size, token) in enumerate(ends):
            left = last[-size]
            if left < 0 or (fits := self.pairs.get(left * self.width + token)) or fits is None and self._fitting(left, token):
                if k:
                    ends[0], ends[k] = ends[k], ends[0]
                return token
        raise AssertionError("a prefix without encoding")

    def encode(self, piece: bytes) -> list[int]:
        state, out, last, width = 0, [], [-1], self.width
        moves, pairs = self.moves.get, self.pairs.get
        for at in range(0, len(piece), self.STEP):
            for byte in piece[at : at + self.STEP]:
                state, ends = moves(state << 8 | byte) or self._move(state, byte)
                size, token = ends[0]
                left = last[-size]
                if left >= 0 and not pairs(left * width + token):
                    token = self._other(ends, last)
                last.append(token)
            if at + self.STEP < len(piece) and (cut := self._settled(last, state)):
                done = self._back(last, cut)
                out += done
                last = [done[-1], *last[cut + 1 :]]
        return out + self._back(last, len(last) - 1)


class Utf8Stream:
    """Incremental UTF-8 state machine: chunks of bytes in, text out; at most three bytes wait for their continuation."""

    def __init__(self) -> None:
        self.waiting = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many of the last bytes are a character that has begun but not ended."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.waiting + chunk
        cut = len(data) - self._open(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.waiting = self.waiting, b""
        return data.decode("utf-8", "replace")


#: A space that doesn't begin a piece of its own word: one before other white space or the end.
ODD_SPACE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """Splits texts by a pattern and encodes each piece; decodes ids as a stream of chunks.

    The pattern must end a piece before each space that a word follows, as the patterns of this family of vocabularies do.
    So a text without other spaces is split there first, and words seen before need no pattern.
    """

    CHUNK = 8192

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine = Transducer(ranks)
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self.bytes_of = [b""] * self.machine.width
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.bytes_of_decimal = {str(rank): token for token, rank in ranks.items()}

    def _piece(self, piece: str) -> str:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)  # a piece that is a token is that token
        out = str(whole) if whole is not None else ",".join(map(str, self.machine.encode(data)))
        if len(piece) <= 64:
            if len(self.pieces) >= MAX_PIECES:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def _pieces(self, text: str) -> str:
        known, make = self.pieces.get, self._piece
        return ",".join([known(p) or make(p) for p in self.split(text)])

    def _word(self, word: str) -> str:
        out = self._pieces(" " + word)
        if len(word) <= 64:
            if len(self.words) >= MAX_PIECES:
                self.words.clear()
            self.words[word] = out
        return out

    def encode_joined(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        if not text or ODD_SPACE.search(text):
            return self._pieces(text)
        first, *words = text.split(" ")
        known, make = self.words.get, self._word
        ids = [known(w) or make(w) for w in words]
        return ",".join([self._pieces(first), *ids] if first else ids)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text).split(",")] if text else []

    def decode(self, ids: list[int] | list[str]):
        """Yields the text of the ids (numbers or decimals), chunk by chunk."""
        stream, bytes_of = Utf8Stream(), self.bytes_of_decimal if ids and isinstance(ids[0], str) else self.bytes_of
        for at in range(0, len(ids), self.CHUNK):
            yield stream.feed(b"".join([bytes_of[i] for i in ids[at : at + self.CHUNK]]))
        yield stream.end()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each document: doc_id and token_ids, the BPE ids of the whole text (null counts as empty)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        ids = [e.encode(t or "") for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    small_batches(docs.sparkSession)
    return map_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), run, "doc_id long, token_ids array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The inverse: doc_id and text from doc_id and token_ids; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        texts = ["".join(e.decode(ids or [])) for ids in batch["token_ids"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    small_batches(tokens.sparkSession)
    return map_batches(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids"), run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text and keeps digests of both ways.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes). A null
    text counts as empty: no tokens, and the digests of nothing. Rows with a null or repeated doc_id stay as they are;
    other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        counts, digests, back = [], [], []
        for text in batch["text"].to_pylist():
            joined = e.encode_joined(text or "")
            ids = joined.split(",") if joined else []
            counts.append(len(ids))
            digests.append(hashlib.sha256(joined.encode()).hexdigest())
            whole = hashlib.sha256()
            for part in e.decode(ids):
                whole.update(part.encode("utf-8"))
            back.append(whole.hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    small_batches(docs.sparkSession)
    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return map_batches(source, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
