"""GIF as a media column: LZW coding, palettes, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import map_batches, small_batches, spread

WIDTH = 64
#: Rows of pixels in a frame of a stored payload, and its time in hundredths of a second.
ROWS, DELAY = 1024, 10
#: A colour for each byte: its first three bits are red, the next three green and the last two blue, so the colours of a
#: picture tell the bytes, and bytes spread over all 64 colours of a histogram.
COLOURS = bytes(x for v in range(256) for x in (v & 0xE0, (v & 0x1C) << 3, (v & 3) << 6))
#: Pixels of a screen that is still decoded; a header can ask for more than any memory holds.
MOST_PIXELS = 1 << 26
BYTES = [bytes((v,)) for v in range(256)]
#: Values 0 to 255 of a channel to four steps.
STEPS = np.arange(256, dtype=np.uint8) >> 6


def _schedule(bits: int) -> np.ndarray:
    """The width of the i-th code after a clear code, as far as the table grows."""
    first = (1 << bits) + 2
    at = np.arange(4096 - first + 2)
    widths = np.full(len(at), bits + 1)
    for w in range(bits + 1, 12):
        widths[first - 1 + at >= 1 << w] = w + 1
    widths[0] = bits + 1
    return widths


def lzw_encode(pixels: bytes, bits: int = 8) -> bytes:
    """LZW code stream of GIF; clears its table whenever that is full."""
    clear = 1 << bits
    codes = [clear]
    emit = codes.append
    table: dict[int, int] = {}
    rest = iter(pixels)
    get, size, word = table.get, clear + 2, next(rest, -1)
    for b in rest:
        key = word << 8 | b
        code = get(key)
        if code is not None:
            word = code
            continue
        emit(word)
        word = b
        table[key] = size
        size += 1
        if size == 4096:
            emit(clear)
            table.clear()
            size = clear + 2
    if word >= 0:
        emit(word)
    emit(clear + 1)
    return _packed(np.array(codes, np.uint16), bits)


def _packed(codes: np.ndarray, bits: int) -> bytes:
    plan, index = _schedule(bits), np.arange(len(codes))
    starts = np.concatenate([[0], np.flatnonzero(codes == 1 << bits) + 1])
    since = index - starts[np.searchsorted(starts, index, "right") - 1]
    widths = plan[np.minimum(since, len(plan) - 1)].astype(np.uint8)
    each = np.unpackbits(codes.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(each[np.arange(16, dtype=np.uint8) < widths[:, None]], bitorder="little").tobytes()


def _strings(codes: np.ndarray, clear: int) -> bytes:
    """What the codes between two clear codes stand for. A code that isn't a sample stands for the string of an earlier
    code and one more sample, so both the lengths and the samples follow from chains of earlier places; doubling the
    links of all chains at once ends after as many rounds as the logarithm of the longest."""
    i = np.arange(len(codes))
    literal = codes < clear
    parent = np.where(literal, i, codes - clear - 2)
    wrong = np.flatnonzero(~literal & (parent >= i))
    if len(wrong):
        return _strings(codes[: wrong[0]], clear)
    length, link = (~literal).astype(np.int64), parent
    while not np.array_equal(link[link], link):
        length, link = length + length[link], link[link]
    length += length[link]
    length += 1
    starts = np.cumsum(length) - length
    source = np.repeat(starts[parent] - starts, length)
    source += np.arange(len(source))
    while not np.array_equal(further := source[source], source):
        source = further
    samples = np.zeros(len(source), np.uint8)
    samples[starts[literal]] = codes[literal]
    return samples[source].tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The pixels of a code stream, up to so many; a stream that breaks off or is wrong gives those before the fault."""
    clear, plan = 1 << bits, _schedule(bits)
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at, out, made = 8 * len(data), 0, [], 0
    offsets = np.cumsum(plan) - plan
    while at + bits < total and made < most:
        widths, begins = plan, at + offsets
        while True:
            fits = begins + widths <= total
            widths, begins = widths[fits].astype(np.uint32), begins[fits]
            place = begins >> 3
            codes = (stream[place] | stream[place + 1] << 8 | stream[place + 2] << 16) >> (begins & 7).astype(np.uint32) & ((1 << widths) - 1)
            stops = np.flatnonzero(codes >> 1 == clear >> 1)
            if len(stops) or not fits.all():
                break
            more = begins[-1] + widths[-1] + 12 * np.arange(len(begins))  # the table stays full: codes of 12 bits go on
            widths, begins = np.concatenate([widths, np.full(len(more), 12)]), np.concatenate([begins, more])
        stop = int(stops[0]) if len(stops) else len(codes)
        if stop:
            out.append(_strings(codes[:stop].astype(np.int64), clear))
            made += len(out[-1])
        if not len(stops) or codes[stop] == clear + 1:
            break
        at = int(begins[stop] + widths[stop])
    return b"".join(out)[:most]


@dataclass
class Frame:
    """A shown picture: when it begins and for how long (milliseconds), its RGB canvas, and the part that the frame drew."""

    start_ms: int
    delay_ms: int
    canvas: np.ndarray
    box: tuple[int, int, int, int]

    def histogram(self) -> np.ndarray:
        """Pixels in each of 4 x 4 x 4 colours."""
        s = STEPS[self.canvas]
        return np.bincount((s[..., 0] << 4 | s[..., 1] << 2 | s[..., 2]).ravel(), minlength=64)


def write_gif(frames: list[np.ndarray], palette: bytes = COLOURS, delay: int = DELAY) -> bytes:
    """Frames of 8-bit samples as an animation; the first gives the size of the screen."""
    height, width = frames[0].shape
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for pixels in frames:
        h, w = pixels.shape
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, w, h, 0), b"\x08"]
        data = lzw_encode(pixels.tobytes())
        for at in range(0, len(data), 255):
            part = data[at : at + 255]
            out += [BYTES[len(part)], part]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and (n := data[at]):
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def read_gif(data: bytes) -> Iterator[Frame]:
    """The frames as shown. A file that breaks off gives the frames before; what is no GIF, or has a screen or a frame of
    more than MOST_PIXELS, gives none from there on."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if width * height > MOST_PIXELS:
        return
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        palette, at = np.frombuffer(data[at : at + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3), at + size
    ground = palette[back] if palette is not None and back < len(palette) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = ground
    time, delay, disposal, clear = 0, 0, 0, -1
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 2 < len(data):
            block, end = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, struct.unpack_from("<H", block, 1)[0]
                clear = block[3] if block[0] & 1 else -1
            at = end
        elif kind == 0x2C and at + 11 <= len(data):
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = palette
            if flags & 0x80:
                size = 3 << (flags & 7) + 1
                colours, at = np.frombuffer(data[at : at + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3), at + size
            if at >= len(data) or not 1 < data[at] < 9 or w * h > MOST_PIXELS:
                return
            bits = data[at]
            block, at = _blocks(data, at + 1)
            pixels = np.frombuffer(lzw_decode(block, bits, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:  # interlaced
                order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(pixels)
                straight[order] = pixels
                pixels = straight
            if colours is None:
                colours = np.zeros((256, 3), np.uint8)
            full = np.zeros((256, 3), np.uint8)
            full[: len(colours)] = colours
            before = canvas.copy() if disposal == 3 else None
            part = canvas[y : y + h, x : x + w]
            pixels = pixels[: part.shape[0], : part.shape[1]]
            shown = full[pixels]
            if clear >= 0:
                shown = np.where((pixels == clear)[..., None], part, shown)
            part[:] = shown
            yield Frame(time, 10 * delay, canvas.copy(), (x, y, w, h))
            time += 10 * delay
            if disposal == 2:
                part[:] = ground
            elif before is not None:
                canvas = before
            delay, disposal, clear = 0, 0, -1
        else:
            return  # the trailer, or a fault


def payload_gif(data: bytes) -> bytes:
    """Bytes as pixels, each in a colour of its own: 0 is appended up to a positive multiple of 64, and each 1024 rows are a
    frame."""
    data = data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")
    pixels = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return write_gif([pixels[at : at + ROWS] for at in range(0, len(pixels), ROWS)])


def stored_payload(media: bytes) -> tuple[bytes, np.ndarray, int, int]:
    """The bytes that payload_gif stored, told by the colours of the frames as shown; the sum of the frames' histograms of
    what they drew; how many frames there are, and their time in milliseconds."""
    parts, histogram, n, time = [], np.zeros(64, np.int64), 0, 0
    for frame in read_gif(media):
        x, y, w, h = frame.box
        drawn = frame.canvas[y : y + h, x : x + w]
        parts.append((drawn[..., 0] | drawn[..., 1] >> 3 | drawn[..., 2] >> 6).tobytes())
        histogram += Frame(0, 0, drawn, frame.box).histogram()
        n, time = n + 1, time + frame.delay_ms
    return b"".join(parts), histogram, n, time


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text; null counts as empty) and media, the GIF that stores the whole text. Repeated rows
    and null ids stay as they are, other columns are ignored, and an empty table gives an empty one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch["text"].to_pylist()]
        media = pa.array([payload_gif(t) for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(spread(source), run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame) -> DataFrame:
    """One row for each frame of the GIFs in column media: doc_id, frame, start_ms, delay_ms, width, height, pixels (RGB,
    row by row) and histogram (64 colours). Null, empty and broken media give the frames that can be read, maybe none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist(), strict=True):
                for k, f in enumerate(read_gif(data or b"")):
                    h, w, _ = f.canvas.shape
                    row = {"doc_id": doc, "frame": k, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "width": w, "height": h, "pixels": f.canvas.tobytes(), "histogram": f.histogram().tolist()}
                    yield pa.RecordBatch.from_pylist([row], FRAME)

    small_batches(media.sparkSession)
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, pixels binary, histogram array<long>")


FRAME = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))])


def media_digests(media: DataFrame) -> DataFrame:
    """Reads the stored bytes of encode_media back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the
    last 64 bytes), media_bytes, media_sha256, feature (how many pixels have each of 64 colours, over all frames, joined by
    commas), n_frames and duration_ms. Null media give nulls; what is no GIF gives an empty payload."""

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        payload, histogram, n, time = stored_payload(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, histogram.tolist())), n, time

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(data.as_py()) for data in batch["media"]]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms"])

    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"
    return map_batches(media.select("doc_id", "n_bytes", "media"), run, f"doc_id long, n_bytes long, {kind}")
