"""Stupid-backoff scores of documents, computed relationally.

A word's score is c(uv) / c(u) if the run uv of the words before and it is in the count table, and 0.4 times its score after
one word less if not; a single word scores c(v) / N. Runs are told apart by 64-bit hashes.

The first job counts the runs, bucket by bucket (the first bits of their hashes), into a table partitioned by bucket. Of the
longest runs it keeps the frequent ones alone. The second explodes the documents again and sends each word with its run to a
bucket, that of the words before it. There it meets the counts of these, and the count table of the longest runs, which is
made of all their occurrences. A word whose run isn't in the table goes on to the bucket of the run of one word less, in a
further round; rounds end when nothing has backed off. What the words add is summed by document.

Words are found and hashed in the bytes of many texts at once, without a Python string for each.

Runs travel packed: a row holds those of many documents for one bucket. The frequent runs are those that make up at least
1 / FREQUENT of all words, as these are estimated from the size, so their table has a bounded size. A word with such a run is
scored where it is found, and runs that follow frequent words are dealt by their own hash, with these words' counts from that
table. So no run can weigh more than that in a task. A task holds the runs of one bucket; there are the more buckets the
larger the corpus is.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import small_batches, spread, written
from lantern.llm.neardup import _mixed

#: The weight of backing off.
BACKOFF = 0.4
#: Words after which a task sends what it has gathered.
FLUSH = 1 << 20
#: Runs that a bucket is meant to have, and the fewest buckets (as a power of two).
BUCKET_RUNS, LEAST_BITS = 1 << 20, 10
#: Tasks send rows of at most so many ranges (a power of two), each cut into its buckets where it arrives. So the runs of a
#: row don't get fewer as the buckets get more.
RANGE_BITS = 14
#: Documents whose sums go together, and the fewest such parts.
PART_DOCUMENTS, LEAST_PARTS = 1 << 17, 256
#: A run with at least this share of all words is looked up where it is found.
FREQUENT = 1 << 20
#: Bytes that a word is taken to have.
WORD_BYTES = 6
#: Stands for words that aren't frequent, among the places of those that are.
RARE = (1 << 24) - 1
#: White space of several bytes, as one number each; that of one byte is 9 to 13 and 28 to 32. It is what str.split takes for it.
WIDE_WHITE = np.array([int.from_bytes(chr(k).encode()) for k in range(0x80, 0x3001) if chr(k).isspace()], np.uint32)
#: Words of at most so many bytes are hashed together, eight bytes a step.
SHORT = 128
#: Keeps the first so many bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: What rows hold: part of the count table, words with runs of place >= 1 words, sums by document (not yet dealt by part).
TABLE, SUMS, LOOSE_SUMS = 0, -1, -2


def pair_keys(w: np.ndarray) -> np.ndarray:
    return _mixed(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])


def run_key(words: list[np.ndarray]) -> np.ndarray:
    """The keys of runs, given by their first words, second words and so on."""
    while len(words) > 1:
        words = [_mixed(u * np.uint64(0x9E3779B97F4A7C15) + v) for u, v in zip(words, words[1:])]
    return words[0]


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 (with two more at the end) belong to white space."""
    white = (data - np.uint8(9) < 5) | (data - np.uint8(28) < 5)
    two = np.flatnonzero(data[:-2] == 0xC2)
    three = np.flatnonzero(data[:-2] - np.uint8(0xE1) < 3)
    for at, n in ((two, 2), (three, 3)):
        code = np.zeros(len(at), np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | data[at + k]
        at = at[np.isin(code, WIDE_WHITE)]
        for k in range(n):
            white[at + k] = True
    return white


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (split at white space) of some texts, one after the other, and the number of words of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, edges, held = texts.buffers()
    edges = np.frombuffer(edges, np.int64, len(texts) + 1, 8 * texts.offset) if edges else np.zeros(1, np.int64)
    data = np.zeros(edges[-1] - edges[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(held, np.uint8, len(data) - 8, edges[0])
    edges = edges - edges[0]
    white, edge = np.ones(len(data) - 6, bool), np.zeros(len(data) - 7, bool)
    white[1:-1], edge[edges] = _white(data[:-6])[:-2], True  # the byte before place k is white[k], that at it white[k + 1]
    start, end = np.flatnonzero(~white[1:] & (white[:-1] | edge)), np.flatnonzero(~white[:-1] & (white[1:] | edge))
    size = end - start
    key = _mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    key = _mixed(key ^ (eight[start] & FIRST[np.minimum(size, 8)]))
    rest = np.flatnonzero((size > 8) & (size <= SHORT))
    for k in range(8, SHORT, 8):
        rest = rest[size[rest] > k]
        if not len(rest):
            break
        key[rest] = _mixed(key[rest] ^ (eight[start[rest] + k] & FIRST[np.minimum(size[rest] - k, 8)]))
    for k in np.flatnonzero(size > SHORT):
        key[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return key, np.diff(np.searchsorted(start, edges))


class Runs:
    """The words of some documents one after the other: place of the document, words before and after within it."""

    def __init__(self, texts: pa.Array) -> None:
        self.words, self.sizes = word_keys(texts)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        ends = np.cumsum(self.sizes)
        at = np.arange(len(self.words))
        self.before, self.left = at - (ends - self.sizes)[self.doc], ends[self.doc] - at

    def of(self, n: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and documents of the runs of n words. key: those of all places, as pair_keys makes them."""
        whole = self.left[: len(key)] >= n
        return key[whole], self.doc[: len(key)][whole]

    def scored(self, n: int, order: int) -> np.ndarray:
        """Places where runs of n words begin whose last word is scored by them: the longest, and beginnings of documents."""
        return np.flatnonzero((self.left >= n) & ((self.before == 0) | (n == order)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Runs]]:
    """Documents of a few batches together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ids.append(batch["doc_id"].to_numpy())
        texts.append(batch["text"].cast(pa.large_string()))
        size += batch["text"].nbytes
        if size >= 6 * FLUSH:
            yield np.concatenate(ids), Runs(pa.concat_arrays(texts))
            ids, texts, size = [], [], 0
    if texts:
        yield np.concatenate(ids), Runs(pa.concat_arrays(texts))


def _packed(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 512):
        some = list(zip(*rows[at : at + 512], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(some, kinds, strict=True)], names)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each stretch of equal ones."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    return list(zip(bucket[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if len(bucket) else []


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in as few bytes each as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else np.uint8).astype(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _slices(rows: Iterator[tuple], bits: int, names: list[str], kinds: list[pa.DataType], cut) -> Iterator[pa.RecordBatch]:
    """Rows of ranges cut into rows of buckets, in the task that has the range."""
    out = []
    for row in rows:
        out += cut(row, np.uint64(64 - bits))
        if len(out) >= 4096:
            yield from _packed(out, names, kinds)
            out = []
    yield from _packed(out, names, kinds)


def count_table(source: DataFrame, order: int, bits: int, keep: int = 1) -> DataFrame:
    """bucket, longest, keys, counts (packed, of the runs of one to order words) and tokens (their sum over all rows is the
    number of words). keep: runs of order words (if these are more than one) that are seen less often are left out; the others
    then have rows of their own, marked as longest. Tasks send a row for each of at most 2^RANGE_BITS ranges, however many
    buckets there are; the task that has a range cuts its rows into buckets and sorts these."""
    ranges = min(bits, RANGE_BITS)
    shift = np.uint64(64 - ranges)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs in _gathered(batches):
            rows, tokens, key = [], len(runs.words), runs.words
            for n in range(1, order + 1):
                found, count = np.unique(runs.of(n, key)[0], return_counts=True)
                for b, i, j in _cuts((found >> shift).astype(np.int64)):
                    rows.append((b, keep > 1 and 1 < n == order, found[i:j].tobytes(), _narrow(count[i:j]).tobytes(), tokens))
                    tokens = 0
                key = pair_keys(key) if len(key) else key
            yield from _packed(rows, names, kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, tokens, held, rows = None, [], [], 0, 0, []

        def done() -> tuple:
            key, n = _merged(keys, counts)
            kept = n >= (keep if at[1] else 1)
            return *at, key[kept].tobytes(), _narrow(n[kept]).tobytes(), tokens

        for batch in batches:
            for *b, k, c, t in zip(*(batch[x].to_pylist() for x in names), strict=True):
                if b != at:
                    if at is not None:
                        rows.append(done())
                    at, keys, counts, tokens, held = b, [], [], 0, 0
                    if len(rows) >= 256:
                        yield from _packed(rows, names, kinds)
                        rows = []
                keys.append(np.frombuffer(k, np.uint64))
                counts.append(_wide(c, len(keys[-1])))
                tokens, held = tokens + t, held + len(keys[-1])
                if held > 4 * BUCKET_RUNS:  # only the distinct runs of a bucket are held
                    key, n = _merged(keys, counts)
                    keys, counts, held = [key], [n], len(key) - 2 * BUCKET_RUNS
        if at is not None:
            rows.append(done())
        yield from _packed(rows, names, kinds)

    def cut(row: tuple, at: np.uint64) -> list[tuple]:
        _, longest, k, c, tokens = row
        key = np.frombuffer(k, np.uint64)
        width, out = len(c) // max(len(key), 1), []
        for b, i, j in _cuts((key >> at).astype(np.int64)):
            out.append((b, longest, k[8 * i : 8 * j], c[width * i : width * j], tokens))
            tokens = 0
        return out

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _slices((row for batch in batches for row in zip(*(batch[x].to_pylist() for x in names), strict=True)), bits, names, kinds, cut)

    names, kinds = ["bucket", "longest", "keys", "counts", "tokens"], [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64()]
    kind = "bucket long, longest boolean, keys binary, counts binary, tokens long"
    dealt = source.mapInArrow(explode, kind).repartition("bucket")
    dealt = dealt.mapInArrow(buckets, kind) if bits > ranges else dealt
    return dealt.sortWithinPartitions("bucket", "longest").mapInArrow(count, kind)


def frequent(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and counts of the runs that are seen so often: a table of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                key = np.frombuffer(k, np.uint64)
                count = _wide(c, len(key))
                if (some := count >= least).any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(count[some])], ["key", "n"])

    found = table.select("keys", "counts").mapInArrow(run, "key long, n long").toArrow()
    key, count = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(key)
    return key[order], count[order]


class Frequent:
    """Counts of the frequent runs by key, and scores of words by them. A table by the first bits of a key has the place where
    such keys begin, so that most runs are found or told from the others at the first look."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, least: int, backoff: float) -> None:
        self.keys, self.counts, self.total, self.least, self.backoff = keys, counts.astype(float), total, least, backoff
        bits = len(keys).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places among the frequent runs, RARE for others."""
        out = np.full(len(keys), RARE, np.uint32)
        if not len(self.keys):
            return out
        last = len(self.keys) - 1
        at = np.minimum(self.begin[keys >> self.shift], last)
        found = self.keys[at]
        np.copyto(out, at, where=found == keys, casting="unsafe")
        some = np.flatnonzero((found < keys) & (at < last))
        at, keys = at[some], keys[some]
        while len(some):
            at = at + 1
            found = self.keys[at]
            right = found == keys
            out[some[right]] = at[right]
            more = (found < keys) & (at < last)
            some, at, keys = some[more], at[more], keys[more]
        return out

    def scores(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which runs are frequent, and the logarithms of the scores of their last words. All parts of a frequent run are
        frequent, so that it can back off here."""
        place = self.places(run_key(words))
        known = place != RARE
        count, some = self.counts[place[known]], [w[known] for w in words]
        if len(words) == 1:
            return known, np.log(count / self.total)
        seen = count >= self.least
        value = np.log(count / self.counts[self.places(run_key(some[:-1]))])
        if not seen.all():
            value[~seen] = np.log(self.backoff) + self.scores([w[~seen] for w in some[1:]])[1]
        return known, value


def _coded(words: list[np.ndarray], frequent: Frequent) -> Callable[[int, int], bytes]:
    """Packs stretches of runs: frequent words take three bytes, others eight more."""
    places = [frequent.places(w) for w in words]
    parts = [(p.astype(np.uint16), (p >> np.uint32(16)).astype(np.uint8), p == RARE, w) for p, w in zip(places, words, strict=True)]
    return lambda i, j: b"".join(x.tobytes() for low, high, rare, w in parts for x in (low[i:j], high[i:j], w[i:j][rare[i:j]]))


def _words(data: bytes, n: int, length: int, frequent: Frequent) -> list[np.ndarray]:
    """The words of n runs of this length."""
    out, at = [], 0
    for _ in range(length):
        place = np.frombuffer(data, np.uint16, n, at) + (np.frombuffer(data, np.uint8, n, at + 2 * n).astype(np.uint32) << np.uint32(16))
        rare = place == RARE
        words = np.empty(n, np.uint64)
        words[~rare] = frequent.keys[place[~rare]]
        words[rare] = np.frombuffer(data, np.uint64, int(rare.sum()), at + 3 * n)
        out.append(words)
        at += 3 * n + 8 * int(rare.sum())
    return out


def _scores(source: DataFrame, least: int, backoff: float, order: int) -> DataFrame:
    """doc_id, log_score and n_tokens."""
    known = source.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).first()
    size, parts = known["size"] or 0, max(LEAST_PARTS, known["n"] // PART_DOCUMENTS)
    bits = max(LEAST_BITS, int(max(order * size / WORD_BYTES / BUCKET_RUNS, 1)).bit_length())
    ranges = min(bits, RANGE_BITS)
    shift, beyond = np.uint64(64 - bits), bits - ranges
    often = max(size // WORD_BYTES // FREQUENT, 2)
    table = written(count_table(source, order, bits, often), "counts")
    total = table.agg(F.sum("tokens")).first()[0] or 0
    hot = frequent(table, often)
    names, kinds = ["bucket", "place", "keys", "ids", "head"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    kind = "bucket long, place int, keys binary, ids binary, head binary"
    made: list[Frequent] = []

    def often_seen() -> Frequent:
        if not made:
            made.append(Frequent(*hot, total, least, backoff))
        return made[0]

    def sent(words: list[np.ndarray], doc: np.ndarray, sign: int = 1, wide: int = beyond) -> list[tuple]:
        """Rows of words with their runs, one for each range (of 2^wide buckets). A longest run is dealt by the words before
        its last, unless these are frequent. sign: -1 for runs whose count is what a score is divided by."""
        n = len(words)
        at = run_key(words)
        if 1 < n == order:
            before = run_key(words[:-1])
            at = np.where(often_seen().places(before) == RARE, before, at)
        bucket = (at >> shift).astype(np.int64)
        place = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        doc, bucket, out = doc[place], bucket[place], []
        packed = _coded([w[place] for w in words], often_seen())
        for b, i, j in _cuts(bucket >> wide):
            some = doc[i:j]
            low = int(some.min())  # ids are sent as their distance from the least one
            out.append((b, n, packed(i, j), _narrow((some - low).view(np.uint64)).tobytes(), struct.pack("<qqb", low, j - i, sign)))
        return out

    def taken(k: bytes, i: bytes, head: bytes, length: int) -> tuple[list[np.ndarray], np.ndarray, int]:
        low, n, sign = struct.unpack("<qqb", head)
        return _words(k, n, length, often_seen()), _wide(i, n) + low, sign

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, runs in _gathered(batches):
            rows, value = [], np.zeros(len(ids))
            for n in range(1, order + 1):
                first = runs.scored(n, order)
                words, doc = [runs.words[first + k] for k in range(n)], runs.doc[first]
                here, scores = often_seen().scores(words)
                value += np.bincount(doc[here], scores, len(ids))
                rows += sent([w[~here] for w in words], ids[doc[~here]])
            rows.append((int(ids[0]) % (1 << ranges), LOOSE_SUMS, ids.tobytes(), runs.sizes.tobytes(), value.tobytes()))
            yield from _packed(rows, names, kinds)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, longest, found, held, out = None, np.empty(0, np.uint64), np.empty(0), [], [], 0, []

        def scored(doc: np.ndarray, value: np.ndarray) -> None:
            nonlocal held
            found.append((doc, value, np.zeros(len(doc))))
            held += len(doc)

        def counted(key: np.ndarray) -> np.ndarray:
            """Counts by the bucket's part of the table, 0 for runs that aren't in it."""
            if not len(keys):
                return np.zeros(len(key))
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[place] == key, counts[place], 0.0)

        def back_off(words: list[np.ndarray], doc: np.ndarray) -> None:
            """The last words with the words before them but the first."""
            if len(doc):
                scored(doc, np.full(len(doc), np.log(backoff)))
                here, scores = often_seen().scores(words[1:])
                scored(doc[here], scores)
                out.extend(sent([w[~here] for w in words[1:]], doc[~here]))

        def look_up_longest() -> None:
            """All occurrences of the bucket's longest runs make their part of the count table, and are looked up in it."""
            words, doc = [np.concatenate(w) for w in zip(*(w for w, _ in longest), strict=True)], np.concatenate([d for _, d in longest])
            _, place, n = np.unique(run_key(words), return_inverse=True, return_counts=True)
            count, before = n[place], run_key(words[:-1])
            spot = often_seen().places(before)
            divisor = counted(before)
            divisor[spot != RARE] = often_seen().counts[spot[spot != RARE]]
            seen = count >= least
            scored(doc[seen], np.log(count[seen] / divisor[seen]))
            back_off([w[~seen] for w in words], doc[~seen])

        def look_up_shorter(words: list[np.ndarray], doc: np.ndarray, sign: int) -> None:
            count = counted(run_key(words))
            if len(words) == 1:
                return scored(doc, np.log(count / total) if sign > 0 else -np.log(count))
            seen = (count >= least) & (count > 0)
            scored(doc[seen], np.log(count[seen]))
            before, rest = run_key(words[:-1])[seen], doc[seen]
            spot = often_seen().places(before)
            scored(rest[spot != RARE], -np.log(often_seen().counts[spot[spot != RARE]]))
            out.extend(sent([before[spot == RARE]], rest[spot == RARE], -1))
            back_off([w[~seen] for w in words], doc[~seen])

        def summed() -> Iterator[pa.RecordBatch]:
            ids, value, n = _by_document(found)
            part = (_mixed(ids.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % parts
            place = np.argsort(part, kind="stable")
            ids, value, n = ids[place], value[place], n[place]
            yield from _packed([(b, SUMS, ids[i:j].tobytes(), _narrow(n[i:j]).tobytes(), value[i:j].tobytes()) for b, i, j in _cuts(part[place])], names, kinds)

        for batch in batches:
            for b, place, k, i, head in zip(*(batch[x].to_pylist() for x in names), strict=True):
                if b != at:
                    if longest:
                        look_up_longest()
                    at, keys, counts, longest = b, np.empty(0, np.uint64), np.empty(0), []
                if place == TABLE:
                    keys = np.frombuffer(k, np.uint64)
                    counts = _wide(i, len(keys)).astype(float)
                elif place == LOOSE_SUMS:
                    found.append((np.frombuffer(k, np.int64), np.frombuffer(head), np.frombuffer(i, np.int64)))
                    held += len(found[-1][0])
                else:
                    words, doc, sign = taken(k, i, head, place)
                    if 1 < place == order:
                        longest.append((words, doc))
                    else:
                        look_up_shorter(words, doc, sign)
                if held > 2 * FLUSH:
                    yield from summed()
                    found, held = [], 0
                if len(out) >= 512:
                    yield from _packed(out, names, kinds)
                    out = []
        if longest:
            look_up_longest()
        if found:
            yield from summed()
        yield from _packed(out, names, kinds)

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, held = None, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _by_document(found)], ["doc_id", "log_score", "n_tokens"])

        for batch in batches:
            for b, k, n, v in zip(*(batch[x].to_pylist() for x in ("bucket", "keys", "ids", "head")), strict=True):
                if b != at and found:
                    yield done()
                    found, held = [], 0
                at = b
                found.append((np.frombuffer(k, np.int64), np.frombuffer(v), _wide(n, len(k) // 8)))
                held += len(found[-1][0])
                if held > FLUSH:
                    found = [_by_document(found)]
                    held = len(found[0][0]) // 2
        if found:
            yield done()

    def cut(row: tuple, at: np.uint64) -> list[tuple]:
        b, place, k, i, head = row
        if place == LOOSE_SUMS:
            return [(b << beyond, place, k, i, head)]
        if place == TABLE:
            return [(int(np.frombuffer(k, np.uint64, 1)[0] >> at), place, k, i, head)] if k else []
        words, doc, sign = taken(k, i, head, place)
        return sent(words, doc, sign, 0)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _slices((row for batch in batches for row in zip(*(batch[x].to_pylist() for x in names), strict=True)), bits, names, kinds, cut)

    shorter = table.where("not longest").select(
        F.shiftright("bucket", beyond).alias("bucket"), F.lit(TABLE).alias("place"), "keys", F.col("counts").alias("ids"), F.lit(b"").alias("head")
    )
    rows, sums = source.mapInArrow(explode, kind), None
    for _ in range(order):
        met = rows.unionByName(shorter).repartition("bucket")
        met = met.mapInArrow(buckets, kind) if bits > ranges else met
        first = F.when(F.col("place") == TABLE, 0).otherwise(1)
        met = written(met.sortWithinPartitions("bucket", first).mapInArrow(look_up, kind), "scores")
        done = met.where(F.col("place") == SUMS)
        sums = done if sums is None else sums.unionByName(done)
        rows = met.where("place > 0")
        if rows.isEmpty():
            break
    return sums.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total_up, "doc_id long, log_score double, n_tokens long")


def _by_document(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sums of values and of numbers of words, of each document once."""
    ids, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    value, n = (np.bincount(place, np.concatenate([f[c] for f in found])) for c in (1, 2))
    return ids, value, n.astype(np.int64)


def score(docs: DataFrame, least: int = 1, backoff: float = BACKOFF, order: int = 2) -> DataFrame:
    """doc_id, n_tokens, log_score (the sum of the logarithms of the words' scores) and mean_log_score (null if there is no
    word, the sum is then 0).

    order: the longest run of words with a table. least: runs of two words or more that are seen less often aren't in it, so
    their words back off; with 1 all runs are in it. A first word scores c(v) / N. Rows with a null id take no part in scores
    or counts; a repeated id is scored as one document, its runs not reaching across. Null, empty and blank texts have no
    words. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null"))
    out = _scores(source, least, backoff, order)
    return out.select("doc_id", "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log_score"))
