"""Sorted 64-bit keys as compact blocks, dealt to tables by their leading bits.

A chunk of documents holds each key once; a block has those of one part of the
key space.  Sums over chunks are made part by part and sent back in the order
of the chunk's own keys.  A block is never larger than its chunk, and with
more parts than keys it is one row for each key, so the volume stays linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textarrays import release


def _places(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value, where its first byte goes and how far the next ones lie, when blocks hold bytes of equal weight side by side."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(first * (width - 1), sizes) + np.arange(int(sizes.sum())), np.repeat(sizes, sizes)


def pack(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Blocks of ``sizes`` values as binary, bytes of equal weight side by side for the shuffle's compression."""
    width = values.itemsize
    at, step = _places(sizes, width)
    raw, by_weight = np.empty(len(values) * width, np.uint8), np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    for j in range(width):
        raw[at + j * step] = by_weight[:, j]
    offsets = np.append(0, np.cumsum(sizes * width)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def unpack(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of all blocks, their sizes)."""
    column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    width = np.dtype(kind).itemsize
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    sizes = np.diff(offsets) // width
    at, step = _places(sizes, width)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.empty((len(at), width), np.uint8)
    for j in range(width):
        out[:, j] = raw[at + j * step]
    return out.reshape(-1).view(kind), sizes


COUNT_SCHEMA = "chunk int, part int, m int, keys binary, counts binary"
_COUNTS = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
TOTAL_SCHEMA = "chunk int, part int, m int, totals binary"
_TOTALS = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("m", pa.int32()), ("totals", pa.binary())])


def split(chunk: int, m: int, keys: np.ndarray, counts: np.ndarray, parts: int, bits: int = 64) -> pa.Table:
    """Rows (chunk, part, m, keys, counts) of ascending keys under 2**bits; the cost follows the keys, not the parts."""
    # The leading 32 bits of a key, times parts: below 2**32 parts this stays in 64 bits.
    top = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    part = ((top * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[first] = keys[first]
    columns = [pa.array(np.full(len(first), chunk, np.int32)), pa.array(part[first]), pa.array(np.full(len(first), m, np.int32)), pack(steps, sizes), pack(counts.astype(np.uint32), sizes)]
    return pa.Table.from_arrays(columns, schema=_COUNTS)


def _sums_within(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.uint64)
    before = np.append(np.uint64(0), total)[np.cumsum(sizes) - sizes]
    return total - np.repeat(before, sizes)


def add_part(blocks: pa.Table) -> pa.Table:
    """The totals of one part, for each of its blocks, in the order of the block's keys."""
    out = []
    for m in sorted(set(blocks["m"].to_pylist())):
        own = blocks.filter(pc.equal(blocks["m"], m))
        steps, sizes = unpack(own["keys"], np.uint64)
        _, back = np.unique(_sums_within(steps, sizes), return_inverse=True)
        total = np.bincount(back, unpack(own["counts"], np.uint32)[0]).astype(np.uint64)[back]
        out.append(pa.Table.from_arrays([own["chunk"], own["part"], own["m"], pack(total, sizes)], schema=_TOTALS))
    release()
    return pa.concat_tables(out)


def totals_of(totals: pa.Table, m: int) -> np.ndarray:
    """A chunk's totals in the order of all its keys."""
    return unpack(totals.filter(pc.equal(totals["m"], m)).sort_by("part")["totals"], np.uint64)[0]
