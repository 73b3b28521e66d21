"""LM scoring: stupid backoff over the corpus's own n-gram counts.

s(w | h) = c(h w) / c(h) if c(h w) > 0, else alpha * s(w | h without its first
word); s(w) = c(w) / N, and half a count for a word never seen.  With
``leave_out`` (default) c and N exclude the document that is scored, so text
found nowhere else backs off.

The method has two forms with the same results.  ``scores_by_rows`` is plain
DataFrame code: documents are exploded into hashed n-grams, counted in a table
partitioned by the hash, joined to that table and summed for each document.
Every n-gram occurrence then crosses the network several times as a row.
``backoff_scores`` does the same steps on packed n-grams, so that they fit a
bounded share of the input: documents are dealt into chunks by a hash of
their id and text; a chunk's distinct n-grams (64-bit hashes, orders 1 to n)
go with their counts to count tables partitioned by the leading bits of the
hash; there the counts of all chunks are added; the totals go back to the
chunks, meet the exploded n-grams of each document and are summed by document.
Chunks carry each distinct n-gram once, so a frequent one weighs as much as a
rare one, and the number of chunks and of table partitions follows the corpus.

Defined cases: null, empty and blank texts have 0 tokens and null scores; very
long texts are whole; repeated rows are separate documents in the counts and
each gets its row; rows without a doc_id, or with one that many texts share, are
spread like others; n-grams that tie in their counts score alike; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import COUNT_SCHEMA, TOTAL_SCHEMA, add_part, split, totals_of
from .scratch import written
from .textarrays import LOWER, hash_runs, slices, window_hashes, word_table

CHUNK_BYTES, PART_GRAMS = 8 << 20, 2_000_000
SCHEMA = "doc_id long, n_tokens long, log_score double, mean_log_score double, n_backed_off long"


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bytes = n_words = 0
    for _, offsets, data in slices(batches):
        starts, _, _ = word_table(offsets, data)
        n_bytes, n_words = n_bytes + len(data), n_words + len(starts)
    yield pa.RecordBatch.from_arrays([pa.array([n_bytes]), pa.array([n_words])], names=["b", "w"])


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and each row's first."""
    parts, firsts, base = [], [np.zeros(1, np.int64)], 0
    for _, offsets, data in slices(table.select(["text"]).combine_chunks().to_batches()):
        starts, ends, first = word_table(offsets, data)
        parts.append(hash_runs(LOWER[data], starts, ends))
        firsts.append(first[1:] + base)
        base += len(starts)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(firsts)


def _grams(words: np.ndarray, first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, place of the last word) of the m-grams inside rows; bit 0..1 of a hash tell no order."""
    if m == 1:
        return words, np.arange(len(words))
    hashes = window_hashes(words, m)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(row[: len(hashes)] == row[m - 1 :][: len(hashes)]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[inside], inside + m - 1


def _count_chunk(docs: pa.Table, order: int, parts: int) -> pa.Table:
    chunk = docs["chunk"][0].as_py()
    words, first = _words(docs)
    return pa.concat_tables(split(chunk, m, *np.unique(_grams(words, first, m)[0], return_counts=True), parts) for m in range(1, order + 1))


def _score_chunk(docs: pa.Table, totals: pa.Table, order: int, alpha: float, n_all: int, leave_out: bool) -> pa.Table:
    words, first = _words(docs)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words)), n_words)
    held: dict[int, np.ndarray] = {}
    for m in range(1, order + 1):
        held[m] = totals_of(totals, m).astype(np.float64)
    rest = n_all - (n_words[row] if leave_out else 0)
    score = backed = context = None
    for m in range(1, order + 1):
        grams, last = _grams(words, first, m)
        _, back = np.unique(grams, return_inverse=True)
        count = held[m][back]
        if leave_out:
            pair, of, times = np.unique(row[last] * np.int64(len(held[m]) + 1) + back, return_inverse=True, return_counts=True)
            count = count - times[of]
        full = np.zeros(len(words))
        full[last] = count
        if m == 1:
            score = np.log(np.maximum(full, 0.5)) - np.log(np.maximum(rest, 1.0))
            backed = full <= 0
        else:
            # The history of the gram that ends at a place ends one place before.
            history = np.zeros(len(words))
            history[last] = context[last - 1]
            seen = full > 0
            inner = np.zeros(len(words), bool)
            inner[last] = True
            score = np.where(seen, np.log(np.where(seen, full, 1.0)) - np.log(np.where(seen, np.maximum(history, full), 1.0)), score + np.where(inner, np.log(alpha), 0.0))
            backed = np.where(inner, ~seen, backed)
        context = full
    sums = np.bincount(row, score, len(n_words)) if len(words) else np.zeros(len(n_words))
    offs = np.bincount(row, backed, len(n_words)).astype(np.int64) if len(words) else np.zeros(len(n_words), np.int64)
    none = n_words == 0
    return pa.Table.from_arrays([docs["doc_id"], pa.array(n_words), pa.array(sums, mask=none), pa.array(np.where(none, 0, sums / np.maximum(n_words, 1)), mask=none), pa.array(offs)], names=["doc_id", "n_tokens", "log_score", "mean_log_score", "n_backed_off"])


def backoff_scores(docs: DataFrame, order: int = 2, alpha: float = 0.4, leave_out: bool = True, chunk_bytes: int = CHUNK_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """doc_id, n_tokens, log_score (natural), mean_log_score, n_backed_off."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.select("text").mapInArrow(_sizes, "b long, w long").agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    chunks, n_all = 1 + size[0] // chunk_bytes, size[1]
    parts = 1 + order * size[1] // part_grams
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    counted = dealt.groupBy("chunk").applyInArrow(lambda t: _count_chunk(t, order, parts), COUNT_SCHEMA)
    totals = counted.groupBy("part").applyInArrow(add_part, TOTAL_SCHEMA)
    return dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(lambda d, t: _score_chunk(d, t, order, alpha, n_all, leave_out), SCHEMA)


def scores_by_rows(docs: DataFrame, order: int = 2, alpha: float = 0.4, leave_out: bool = True) -> DataFrame:
    """doc_id, n_tokens, log_score (natural), mean_log_score, n_backed_off; every n-gram is a row."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("n_tokens", F.size("words").cast("long"))
    at = rows.select("row", "words", F.explode(F.expr("sequence(0, size(words) - 1)")).alias("place")).where("place >= 0 and size(words) > 0")
    # (row, place, m, gram): the m-gram that ends at a place.
    grams = at.select("row", "place", F.explode(F.expr(f"sequence(1, least({order}, place + 1))")).alias("m"), "words").select("row", "place", "m", F.expr("xxhash64(m, slice(words, place - m + 2, m))").alias("gram"))
    own = written(grams.groupBy("row", "m", "gram").agg(F.count("*").alias("own")))
    table = own.groupBy("m", "gram").agg(F.sum("own").alias("total"))
    left = own.join(table, ["m", "gram"]).select("row", "m", "gram", (F.col("total") - (F.col("own") if leave_out else 0)).alias("count"))
    counts = grams.join(left, ["row", "m", "gram"]).groupBy("row", "place").agg(F.map_from_entries(F.collect_list(F.struct("m", F.col("count").cast("double")))).alias("c"))
    before = F.lag("c").over(Window.partitionBy("row").orderBy("place"))
    n_all = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_all"))
    known = counts.withColumn("before", before).join(rows.select("row", "n_tokens"), "row").crossJoin(F.broadcast(n_all))  # one row
    rest = F.greatest(F.col("n_all") - (F.col("n_tokens") if leave_out else 0), F.lit(1)).cast("double")
    score, backed = F.log(F.greatest(F.col("c")[1], F.lit(0.5))) - F.log(rest), F.col("c")[1] <= 0
    for m in range(2, order + 1):
        here = F.try_element_at("c", F.lit(m))
        history = F.try_element_at("before", F.lit(m - 1))
        score = F.when(here.isNull(), score).when(here > 0, F.log(here / F.greatest(history, here))).otherwise(score + F.log(F.lit(alpha)))
        backed = F.when(here.isNull(), backed).otherwise(here <= 0)
    sums = known.groupBy("row").agg(F.sum(score).alias("log_score"), F.sum(backed.cast("long")).alias("n_backed_off"))
    out = rows.join(sums, "row", "left")
    return out.select("doc_id", "n_tokens", "log_score", (F.col("log_score") / F.col("n_tokens")).alias("mean_log_score"), F.coalesce("n_backed_off", F.lit(0)).cast("long").alias("n_backed_off"))
