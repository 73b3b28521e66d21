"""Media columns: GIF.

``decode`` reads a GIF stream: logical screen, global and local palettes,
graphic control (delay, disposal, transparency), interlaced rows and LZW
code streams, and gives timed RGBA frames as a viewer shows them.  ``encode``
stores 8-bit samples as the indices of frames under a grey palette, so that
what is read back from the red channel is what was stored.

LZW codes are unpacked with array operations: the width of the k-th code
after a clear code is known beforehand, so a run of codes is cut out of the
bit stream at once and ends at the first clear or end code.  Strings follow
by the rule that the entry made by code k is the output of code k and one
byte more, which is a copy from what is already written.

A stream is read as far as it is right.  What breaks it (an unknown block, a
cut, codes before their entry, samples or colours that are missing, a screen of
more than ``most_pixels``) ends its frames and is told in a row of its own; no
stream stops a job or takes more memory than its screen and its codes need.

Defined cases: a null text is an empty payload of 64 zero bytes; long
payloads are split into frames of at most ``ROWS`` rows; null media have no
frames; empty media are no GIF; equal texts, repeated rows too, give equal
media; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import slices

WIDTH, ROWS, DELAY = 64, 4096, 4
#: Pixels of the largest screen that is read.
PIXELS = 1 << 24
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


class Frame(NamedTuple):
    delay_ms: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    rgba: np.ndarray  #: the whole screen as shown while this frame is on


# ---- LZW


def _widths(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the k-th code after a clear code, and the bit at which it begins."""
    first = (1 << least) + 2
    k = np.arange(1 << 14)
    entries = np.minimum(first + np.maximum(k - 1, 0), 4095)
    width = np.zeros(len(k), np.int64)
    for w in range(least + 1, 13):
        width[(width == 0) & (entries < (1 << w))] = w
    width[width == 0] = 12
    return width, np.cumsum(width) - width


_WIDTHS = {n: _widths(n) for n in range(2, 9)}


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """The code stream, with a clear code at the start and whenever the table is full."""
    clear, end = 1 << least, (1 << least) + 1
    width, at = _WIDTHS[least]
    segments, codes = [], []
    table: dict[int, int] = {}
    free, limit = end + 1, 4095
    emit = codes.append
    get = table.get
    if data:
        source = iter(data)
        current = next(source)
        for byte in source:
            key = (current << 8) | byte
            longer = get(key)
            if longer is not None:
                current = longer
                continue
            emit(current)
            if free == limit:
                emit(clear)
                segments.append(codes)
                codes = []
                emit = codes.append
                table.clear()
                free = end + 1
            else:
                table[key] = free
                free += 1
            current = byte
        emit(current)
    emit(end)
    segments.append(codes)
    values, places, base = [np.array([clear])], [np.zeros(1, np.int64)], least + 1
    for codes in segments:
        n = len(codes)
        values.append(np.array(codes, np.int64))
        places.append(base + at[:n])
        base += int(at[n - 1] + width[n - 1])
    value, place = np.concatenate(values), np.concatenate(places)
    out = np.zeros((base + 7) // 8 + 3, np.int64)
    shifted = value << (place & 7)
    for j in range(3):
        out += np.bincount((place >> 3) + j, (shifted >> (8 * j)) & 255, len(out)).astype(np.int64)
    return out[: (base + 7) // 8].astype(np.uint8).tobytes()


def _codes(stream: np.ndarray, least: int) -> list[np.ndarray]:
    """The codes between clear codes, up to the end code or the end of the bits."""
    clear, end = 1 << least, (1 << least) + 1
    width, at = _WIDTHS[least]
    bits = len(stream) * 8
    padded = np.concatenate([stream, np.zeros(4, np.uint8)]).astype(np.int64)
    found, base, span = [], 0, 4096 - clear + 4
    while base + least + 1 <= bits:
        taken = []
        k = 0
        stop = -1
        while stop < 0:
            n = min(k + span, len(at)) - k
            if n <= 0:
                raise ValueError("no clear code in a full table")
            places = base + at[k : k + n]
            places = places[places + width[k : k + len(places)] <= bits]
            byte = places >> 3
            value = padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16
            value = (value >> (places & 7)) & ((1 << width[k : k + len(places)]) - 1)
            special = np.flatnonzero((value == clear) | (value == end))
            if len(special):
                stop = int(special[0])
                taken.append(value[:stop])
                last = k + stop
                ended = value[stop] == end
                base += int(at[last] + width[last])
            else:
                taken.append(value)
                k += len(places)
                if len(places) < n:
                    stop, ended = 0, True
        found.append(taken[0] if len(taken) == 1 else np.concatenate(taken))
        if ended:
            break
    return found


def lzw_decode(stream: bytes, least: int, most: int | None = None) -> np.ndarray:
    """The samples of a code stream, ``most`` of them at most."""
    if least not in _WIDTHS:
        raise ValueError("an unknown code size")
    first = (1 << least) + 2
    pieces = [p for p in _codes(np.frombuffer(stream, np.uint8), least) if len(p)]
    if not pieces:
        return np.zeros(0, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    code = np.concatenate(pieces)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = len(code)
    literal = code < first - 2
    made = np.where(literal, np.arange(n), begin + code - first)  # the code whose output an entry repeats
    if (made[~literal] >= np.arange(n)[~literal]).any() or (made < 0).any():
        raise ValueError("a code before its entry")
    # Lengths: one more than that of the code repeated; by pointer doubling.
    length, to = np.where(literal, 1, 1).astype(np.int64), made.copy()
    total, live = np.where(literal, 0, 1).astype(np.int64), ~literal
    while live.any():
        at = np.flatnonzero(live)
        total[at] += total[to[at]]
        to[at] = to[to[at]]
        live[at] = ~literal[to[at]] | (total[to[at]] > 0)
    length += total
    start = np.cumsum(length) - length
    if most is not None and (n_kept := int(np.searchsorted(start, most))) < len(start):
        # Entries repeat earlier ones, so what lies behind the last wanted sample is not needed.
        literal, made, length, start, code = (x[:n_kept] for x in (literal, made, length, start, code))
    out = np.zeros(int(length.sum()), np.uint8)
    # Sources: each byte of a repeated string lies where that string was written before.
    source = np.arange(len(out))
    copied = np.repeat(np.where(literal, 0, start - start[made]), length)
    source -= copied
    pending = np.flatnonzero(copied > 0)
    while len(pending):
        onward = source[source[pending]]
        moved = onward != source[pending]
        source[pending] = onward
        pending = pending[moved]
    out[start[literal]] = code[literal]
    return out[source]


# ---- container


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF of one or more timed frames; len(samples) must be a positive multiple of ``width``."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    frames = [samples[i : i + width * rows] for i in range(0, len(samples), width * rows)]
    out = [b"GIF89a", struct.pack("<HHBBB", width, len(frames[0]) // width, 0xF7, 0, 0), GREY.tobytes()]
    for frame in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(frame) // width, 0))
        out += [b"\x08", _blocks(lzw_encode(frame))]
    return b"".join([*out, b"\x3b"])


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) > 0:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _row_order(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _palette(data: bytes, at: int, n: int) -> np.ndarray:
    if at + 3 * n > len(data):
        raise IndexError
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)


def decode(data: bytes, most_pixels: int = PIXELS) -> Iterator[Frame]:
    """Frames in order, composed on the screen under disposal and transparency; ValueError where the stream breaks."""
    try:
        yield from _decode(data, most_pixels)
    except (struct.error, IndexError) as cut:
        raise ValueError("the stream is cut") from cut


def _decode(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most_pixels:
        raise ValueError("too large a screen")
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = _palette(data, at, n)
        at += 3 * n
    screen = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    clear: int | None = None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            _, at = _read_blocks(data, at + 2)
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        local = palette
        if bits & 0x80:
            n = 2 << (bits & 7)
            local = _palette(data, at, n)
            at += 3 * n
        if local is None:
            raise ValueError("no palette")
        least = data[at]
        stream, at = _read_blocks(data, at + 1)
        if w * h > most_pixels:
            raise ValueError("too large a frame")
        index = lzw_decode(stream, least, w * h)[: w * h]
        if len(index) < w * h:
            raise ValueError("too few samples")
        if int(index.max(initial=0)) >= len(local):
            raise ValueError("an index beyond the palette")
        rows = np.empty((h, w), np.uint8)
        rows[_row_order(h, bool(bits & 0x40))] = index.reshape(h, w)
        before = screen.copy() if disposal == 3 else None
        area = screen[top : top + h, left : left + w]
        rows = rows[: area.shape[0], : area.shape[1]]
        if clear is None:
            area[..., :3], area[..., 3] = local[rows], 255
        else:
            shown = rows != clear
            area[shown, :3], area[shown, 3] = local[rows[shown]], 255
        yield Frame(10 * delay, disposal, left, top, w, h, screen)
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            screen = before
        delay = disposal = 0
        clear = None


def histogram(frame: Frame, levels: int = 4) -> np.ndarray:
    """Counts of shown pixels by red, green and blue, in levels**3 equal cells."""
    seen = frame.rgba[frame.rgba[..., 3] > 0]
    step = 256 // levels
    cell = (seen[:, 0] // step).astype(np.int64) * levels * levels + (seen[:, 1] // step) * levels + seen[:, 2] // step
    return np.bincount(cell, minlength=levels**3)


def payload(text: bytes, width: int = WIDTH) -> bytes:
    """The text and zero bytes up to a positive multiple of ``width``."""
    return text + bytes(-len(text) % width or (0 if text else width))


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, offsets, data in slices(batches):
        raw = data.tobytes()
        media = [encode(payload(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _frames(batches: Iterable[pa.RecordBatch], most_pixels: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
    names = ["doc_id", "frame", "delay_ms", "disposal", "width", "height", "rgba", "histogram", "error"]

    def rows_of(key: int | None, media: bytes) -> Iterator[tuple]:
        try:
            for i, f in enumerate(decode(media, most_pixels)):
                yield key, i, f.delay_ms, f.disposal, f.width, f.height, f.rgba.tobytes(), histogram(f).tolist(), None
        except ValueError as broken:
            yield key, None, None, None, None, None, None, None, str(broken)

    for batch in batches:
        for key, media in zip(batch.column(0), batch.column(1), strict=True):
            # One frame at a time: a screen may be large.
            for row in rows_of(key.as_py(), media.as_py()):
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names=names)


def _read_back(media: bytes) -> tuple[bytes, str]:
    """The stored samples, and a feature: frames, time shown, and pixels by quarter of the grey scale."""
    parts, n, shown, grey = [], 0, 0, np.zeros(64, np.int64)
    for f in decode(media):
        part = f.rgba[f.top : f.top + f.height, f.left : f.left + f.width, 0]
        parts.append(part.tobytes())
        grey[[0, 21, 42, 63]] += np.bincount(part.reshape(-1) >> 6, minlength=4)
        n, shown = n + 1, shown + f.delay_ms
    return b"".join(parts), f"frames={n};ms={shown};hist=" + "/".join(str(x) for x in grey[[0, 21, 42, 63]])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for rows in _store(batches):
        out = []
        for media in rows.column(2):
            stored = media.as_py()
            back, feature = _read_back(stored)
            out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=names)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a GIF."""
    return _rows(docs).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, most_pixels: int = PIXELS) -> DataFrame:
    """A row for each frame of doc_id, media: timing, disposal, composed RGBA pixels and their histogram.

    A broken stream ends with a row that has only doc_id and error.
    """
    schema = "doc_id long, frame int, delay_ms int, disposal int, width int, height int, rgba binary, histogram array<long>, error string"
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").where("media is not null").mapInArrow(lambda it: _frames(it, most_pixels), schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Digests of each text stored as a GIF and read back from its bytes, without shipping either between tasks."""
    return _rows(docs).mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
