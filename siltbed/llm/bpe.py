"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression.  Each code point becomes a
class (letter, number, space, other white space, other, the letters that can
follow an apostrophe, ...); a class maps states to states, such maps compose
associatively, and a blocked scan over all texts of a slice gives the state
at every place at once.  State and class tell where a piece begins.  Pieces
are merged by rank and kept in a bounded cache.  Each token keeps the byte
offset in its text at which it ends; decoding puts the tokens' bytes at these
places, for whole texts or for a range of bytes, in one gather for all rows.

The classes of contractions look one code point ahead ("'re" needs both
letters), which keeps the machine free of back-tracking; white space looks
one ahead too, because the last one before a word stands apart.

Defined cases: a null text is empty and has no tokens; very long texts are
whole; repeated rows are encoded each by itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import SLICE_BYTES, slices

# Classes.
LETTER, NUMBER, OTHER, MARK, BLANK, BLANK_LAST, WHITE, WHITE_LAST, SHORT, LONG, BREAK = range(11)
# LETTER: \p{L}; NUMBER: \p{N}; MARK: an apostrophe; BLANK: U+0020, WHITE: other \s, each
# _LAST if the next is no white space; SHORT: s t m d; LONG: r v l with its second letter
# behind it; BREAK: between texts.
# States: what the piece that holds the last code point is.
(S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_MARK, S_MID, S_DONE) = range(9)
# S_BLANK: one U+0020 that the next word may take; S_SPACE: other white space; S_MARK: an
# apostrophe at the start of a piece; S_MID: inside 're 've 'll; S_DONE: a finished contraction.
STATES = 9


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece begin here) by class and state before."""
    step = np.zeros((11, STATES), np.uint8)
    cut = np.ones((11, STATES), bool)
    for before in range(STATES):
        for kind, state in ((LETTER, S_LETTER), (SHORT, S_LETTER), (LONG, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER), (MARK, S_OTHER)):
            step[kind, before] = state
            cut[kind, before] = before not in (state, S_BLANK)
        if before not in (S_OTHER, S_MARK, S_BLANK):
            step[MARK, before] = S_MARK
        for kind in (OTHER, MARK):
            if before == S_MARK:
                cut[kind, before] = False
        for kind, state in ((BLANK, S_SPACE), (WHITE, S_SPACE)):
            step[kind, before] = state
            cut[kind, before] = before != S_SPACE
        step[BLANK_LAST, before], step[WHITE_LAST, before] = S_BLANK, S_SPACE
        step[BREAK, before] = S_START
    step[SHORT, S_MARK], cut[SHORT, S_MARK] = S_DONE, False
    step[LONG, S_MARK], cut[LONG, S_MARK] = S_MID, False
    for kind in (LETTER, SHORT, LONG):
        step[kind, S_MID], cut[kind, S_MID] = S_DONE, False
    return step, cut


STEP, CUT = _tables()
#: White_Space of Unicode, a fixed property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_base: np.ndarray | None = None


def _base_class() -> np.ndarray:
    global _base
    if _base is None:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            major = unicodedata.category(chr(c))[0]
            if major == "L":
                kinds[c] = LETTER
            elif major == "N":
                kinds[c] = NUMBER
        kinds[WHITE_SPACE] = WHITE
        kinds[0x20], kinds[0x27] = BLANK, MARK
        _base = kinds
    return _base


def classes(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Classes with the one code point of look-ahead; ``breaks``: places between texts."""
    kinds = _base_class()[points]
    kinds[breaks] = BREAK
    following = np.empty_like(points)
    following[:-1], following[-1] = points[1:], 0
    ahead = np.empty_like(kinds)
    ahead[:-1], ahead[-1] = kinds[1:], BREAK
    text = kinds == LETTER
    letter = np.where(text, points, 0)
    kinds[(letter == 0x73) | (letter == 0x74) | (letter == 0x6D) | (letter == 0x64)] = SHORT
    kinds[((letter == 0x72) | (letter == 0x76)) & (following == 0x65) | (letter == 0x6C) & (following == 0x6C)] = LONG
    last = (ahead != BLANK) & (ahead != WHITE) & (ahead != BREAK)
    kinds[(kinds == BLANK) & last] = BLANK_LAST
    kinds[(kinds == WHITE) & last] = WHITE_LAST
    return kinds


def scan(kinds: np.ndarray, block: int = 128) -> np.ndarray:
    """The state before every place: compose maps within blocks, then across, then apply."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // block)
    padded = np.full(rows * block, BREAK, np.uint8)
    padded[:n] = kinds
    grid = np.ascontiguousarray(padded.reshape(rows, block).T)
    flat = STEP.reshape(-1)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for j in range(block):
        maps = flat[(grid[j].astype(np.intp) * STATES)[:, None] + maps]
    enter, state = np.empty(rows, np.uint8), 0
    for r, m in enumerate(maps.tolist()):
        enter[r] = state
        state = m[state]
    out = np.empty((block, rows), np.uint8)
    for j in range(block):
        out[j] = enter
        enter = flat[grid[j].astype(np.intp) * STATES + enter]
    return out.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Places where a piece, or a break between texts, begins."""
    kinds = classes(points, breaks)
    return np.flatnonzero(CUT.reshape(-1)[kinds.astype(np.intp) * STATES + scan(kinds)])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank is joined, leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n > 256:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(n)]
    far = 1 << 60
    get = ranks.get
    scores = [get(piece[i : i + 2], far) for i in range(n - 1)]
    while scores:
        best = min(scores)
        if best == far:
            break
        i = scores.index(best)
        parts[i] += parts.pop(i + 1)
        del scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], far)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], far)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap and linked neighbours, for pieces where a list would be quadratic."""
    import heapq

    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Ranks, their bytes, and a bounded cache of merged pieces."""

    def __init__(self, path: str, cache_rows: int = 100_000):
        self.ranks = read_ranks(path)
        self.bytes = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.bytes[i] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.sizes = np.array([len(b) for b in self.bytes] or [0], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.cache: dict[str, list[int]] = {}
        self.cache_rows = cache_rows

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; code points of all texts are scanned together."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        breaks = np.cumsum(sizes) - 1
        cuts = boundaries(points, breaks)
        at = np.searchsorted(cuts, breaks)
        cut = cuts.tolist()
        out, first = [], 0
        for stop in at.tolist():
            out.append([joined[a:b] for a, b in zip(cut[first:stop], cut[first + 1 : stop + 1], strict=True)])
            first = stop + 1
        return out

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        cache, out = self.cache, []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                if len(cache) >= self.cache_rows:
                    cache.clear()
                ids = merge(p.encode("utf-8", "replace"), self.ranks)
                if len(p) <= 64:
                    cache[p] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(self.pieces([text])[0])

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset behind each token."""
        return np.cumsum(self.sizes[ids])

    def decode_at(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of tokens, put where their offsets say."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        sizes = np.diff(ends, prepend=0)
        if (sizes != self.sizes[ids]).any():
            raise ValueError("offsets of other tokens")
        return self.flat[np.repeat(self.first[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = np.fromiter(ids, np.int64)
        return self.decode_at(ids, self.ends(ids)).tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for rows, offsets, data in slices(batches, limit=SLICE_BYTES // 2):
        raw = data.tobytes()
        yield rows, [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _tokens(own: Codec, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Ids by row; all ids, the byte offset behind each in the rows joined, and where rows begin among them."""
    ids = [own.encode_pieces(p) for p in own.pieces(texts)]
    flat = np.fromiter(chain.from_iterable(ids), np.int64)
    return ids, flat, own.ends(flat), np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)


def _encode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for rows, texts in _texts(batches):
        _, flat, ends, at = _tokens(own, texts)
        before = np.append(0, ends)[at]
        local = ends - np.repeat(before[:-1], np.diff(at))
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (flat, local)]
        yield pa.RecordBatch.from_arrays([rows.column(0), *lists], names=["doc_id", "ids", "ends"])


def _digest(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for rows, texts in _texts(batches):
        ids, flat, ends, at = _tokens(own, texts)
        back = own.decode_at(flat, ends).tobytes()
        cuts = np.append(0, ends)[at].tolist()
        a = [hashlib.sha256(" ".join(map(own.decimal.__getitem__, x)).encode()).hexdigest() for x in ids]
        b = [hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _decode(batches: Iterable[pa.RecordBatch], path: str, first: int, last: int | None) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        texts = []
        for ids, ends in zip(batch.column(1), batch.column(2), strict=True):
            if not ids.is_valid or not ends.is_valid:
                texts.append("")
                continue
            i, e = (x.values.to_numpy().astype(np.int64) for x in (ids, ends))
            stop = len(i) if last is None else int(np.searchsorted(e, last, "left")) + 1
            start = int(np.searchsorted(e, first, "right"))
            before = int(e[start - 1]) if start else 0
            part = own.decode_at(i[start:stop], e[start:stop] - before).tobytes()
            texts.append(part[max(first - before, 0) : None if last is None else last - before].decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, ends array<int>: the byte offset behind each token."""
    return _rows(docs).mapInArrow(lambda it: _encode(it, path), "doc_id long, ids array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """doc_id, text, from doc_id, ids and ends: the whole text, or its bytes ``first`` to ``last`` from the tokens that hold them."""
    return encoded.select("doc_id", "ids", "ends").mapInArrow(lambda it: _decode(it, path, first, last), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, without storing either."""
    return _rows(docs).mapInArrow(lambda it: _digest(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
