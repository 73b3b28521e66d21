"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed into a fixed number of buckets.  The raw
multinomial counts every document; the target multinomial counts documents
labelled good, from at most ``trusted_rows`` of them (taken in the order of a
hash of doc_id).  A document's score is the mean over its n-grams of
log(target / raw), both smoothed by adding one, so length does not matter.
A document is kept when no base rule fails and its score reaches the
threshold; the same document always gets the same verdict.

Defined cases: null or blank text has no words, fails the base rules and
scores 0; repeated rows are judged each by itself; an empty table gives an
empty result; without labels both models are equal and all scores are 0;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import NONSPACE, hash_runs, slices, window_hashes, word_table

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("llr", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _ngrams(words: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of pairs; a pair across two rows gets bucket -1."""
    shift = np.uint64(64 - bits)
    one = (words >> shift).astype(np.int64)
    two = (window_hashes(words, 2) >> shift).astype(np.int64)
    last = first[1:-1] - 1
    two[last[(last >= 0) & (last < len(two))]] = -1
    return one, two


def _count(batches: Iterable[pa.RecordBatch], bits: int, trusted: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = 1 << bits
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for rows, offsets, data in slices(batches):
        starts, ends, first = word_table(offsets, data)
        one, two = _ngrams(hash_runs(data, starts, ends), first, bits)
        ids = rows.column(0).to_numpy(zero_copy_only=False)
        good = np.repeat(np.isin(ids, trusted), np.diff(first))
        for grams, mark in ((one, good), (two, good[1:])):
            ok = grams >= 0
            raw += np.bincount(grams[ok], minlength=size)
            target += np.bincount(grams[ok & mark[: len(grams)]], minlength=size)
    at = np.flatnonzero(raw)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def log_ratio(docs: DataFrame, labels: DataFrame, bits: int = 16, trusted_rows: int = 20_000) -> np.ndarray:
    """log(target / raw) by bucket: 2**bits numbers, whatever the corpus holds."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)
    trusted = np.array(sorted(r[0] for r in good.collect()), np.int64)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(lambda it: _count(it, bits, trusted), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(1 << bits), np.ones(1 << bits)
    if len(sums):
        raw[sums["bucket"]] += sums["raw"]
        target[sums["bucket"]] += sums["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(windows: np.ndarray) -> int:
    """Words inside windows that occur twice or more."""
    order = np.sort(windows)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    edge = np.zeros(len(windows) + WINDOW, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge) > 0).sum())


def _judge(batches: Iterable[pa.RecordBatch], ratio: np.ndarray, bits: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for rows, offsets, data in slices(batches):
        starts, ends, first = word_table(offsets, data)
        words = hash_runs(data, starts, ends)
        n_words = np.diff(first)
        n = len(n_words)
        one, two = _ngrams(words, first, bits)
        padded = np.append(ratio, 0.0)
        score = _by_row(padded[one], first)
        pair = np.append(padded[two], 0.0)[: len(words)]
        score = score + _by_row(pair, first)
        grams = np.maximum(2 * n_words - 1, 1)
        score = np.where(n_words > 0, score / grams, 0.0)
        windows = window_hashes(words, WINDOW)
        raw = data.tobytes()
        repeat, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n):
            if n_words[i] > WINDOW:
                repeat[i] = _repeated(windows[first[i] : first[i + 1] - WINDOW + 1])
            text = raw[offsets[i] : offsets[i + 1]]
            if b"\n" in text:
                full = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
                lines[i] = len(full) - len(set(full))
        chars = _by_row(NONSPACE[data] & ((data & 0xC0) != 0x80), offsets)
        failed = (n_words < 20) | (100 * repeat > 30 * n_words)
        kept = ~failed & (score >= threshold)
        columns = [rows.column(0), n_words.astype(np.int64), chars, _by_row(SYMBOL[data], offsets), lines, repeat, score, failed, kept]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=_ARROW)


def quality_rules(docs: DataFrame, labels: DataFrame, bits: int = 16, threshold: float = -0.1, trusted_rows: int = 20_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept."""
    ratio = log_ratio(docs, labels, bits, trusted_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _judge(it, ratio, bits, threshold), SCHEMA)
