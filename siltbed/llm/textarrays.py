"""Array views of text columns, shared by the operators that run inside Arrow batches.

Texts stay in the UTF-8 buffer that Spark hands over: words, shingles and
windows are found for a whole slice of rows at once.  A slice holds at most
``limit`` bytes unless a single text is longer than that, so working memory
follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


BYTE_CODE = _random_words(256, 11)
#: Odd powers of one base; words longer than the table reuse it.
POSITIONS = 1 << 14
POSITION_CODE = _random_words(POSITIONS, 12) | _U(1)
WINDOW_CODE = _random_words(64, 13) | _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that belong to a word [^\x20\x09-\x0D]+ .
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def release() -> None:
    """Gives freed memory back to the system: Python workers live on after a task, and so would its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection whose output bits each depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes) for runs of rows of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        offsets, data = utf8(batch.column(batch.schema.get_field_index(name)))
        first, n = 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            last = min(last, n)
            yield batch.slice(first, last - first), offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
            first = last
        del batch, offsets, data
    release()


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, none of which crosses a row."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(member & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, member[1:]
    inner = offsets[1:][offsets[1:] > 0] - 1
    after[inner] = False
    return starts, np.flatnonzero(member & ~after) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs must be disjoint, ascending and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    shift = np.repeat(starts - first, sizes)
    at = np.arange(int(sizes.sum()), dtype=np.int64)
    within = at - np.repeat(first, sizes)
    code = BYTE_CODE[data[at + shift]] * POSITION_CODE[within & (POSITIONS - 1)]
    return mix(np.add.reduceat(code, first) + sizes.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` successive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += words[j : n + j] * WINDOW_CODE[j]
    return mix(total)


def sequence_hash(words: np.ndarray, salt: int = 0) -> int:
    """One hash of a whole sequence of word hashes."""
    n = len(words)
    place = mix(np.arange(1, n + 1, dtype=np.uint64) + _U(salt)) | _U(1)
    return int(mix(np.array([(words * place).sum(dtype=np.uint64) + _U(n)], np.uint64))[0])


def word_table(offsets: np.ndarray, data: np.ndarray, member: np.ndarray = NONSPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, of): the runs of member bytes, and for each row the place of its first run."""
    starts, ends = runs(member[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
