"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality.  The model is
P(grade > k) = logistic(w . x - theta_k) with one weight vector for all
thresholds, theta_0 < theta_1.  x marks which words a text holds (runs of
letters, lower-cased, as 64-bit hashes) and how dense its words' beginnings
are, since insults are inflected; an L1 penalty leaves few weights.
It is fitted on at most ``sample_rows`` labelled documents of ``sample_features``
words and beginnings together, taken in the order of a hash of doc_id, so what
comes to the driver is bounded in bytes too.  The score is the expected grade;
a document is toxic if P(grade > 0) reaches ``cut``.

Defined cases: null and empty texts score by the thresholds alone; very long
texts are scored whole; words that repeat count once; repeated rows are scored
each by itself, and those that share a labelled doc_id are all in the sample,
which the number of features still bounds; of several labels of a doc_id the
highest grade counts; where a grade has no labels the others keep their
numbers; a score on the cut is toxic; without labels of both kinds nothing is
toxic and the score is 0; an empty table gives an empty result; other columns,
whatever their names, are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written
from .textarrays import BYTE_CODE, LOWER, POSITION_CODE, as_long, hash_runs, mix, release, slices, word_table

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Lengths in bytes of the beginnings of words, and the share of words at which one counts in full.
BEGINNINGS, DENSE = (4, 5, 6, 7), 25.0
#: Entries of the sample that the driver handles at a time, and parts in which it gets them.
STRETCH, PARTS = 1 << 19, 4
SCHEMA = "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean"


class Model(NamedTuple):
    keys: np.ndarray  #: hashes of words, ascending
    weights: np.ndarray
    thetas: np.ndarray
    levels: np.ndarray = np.arange(2)  #: the grades between which the thresholds lie, 0 first


def _marks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of every word and of every beginning of a longer word, and the words of each row.

    The lowest bit of a key tells beginnings from words.
    """
    data = LOWER[data]
    starts, ends, first = word_table(offsets, data, LETTERS)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words)), n_words)
    rows, keys = [row], [hash_runs(data, starts, ends) & ~np.uint64(1)]
    size, total = ends - starts, np.zeros(len(starts), np.uint64)
    for j in range(max(BEGINNINGS)):
        live = size > j
        starts, size, total, row = starts[live], size[live], total[live], row[live]
        total = total + BYTE_CODE[data[starts + j]] * POSITION_CODE[j]
        if j + 1 in BEGINNINGS:
            longer = size > j + 1
            rows.append(row[longer])
            keys.append(mix(total[longer] + np.uint64(j)) | np.uint64(1))
    return np.concatenate(rows), as_long(np.concatenate(keys)), n_words


def _values(keys: np.ndarray, times: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A word counts 1; a beginning counts by its share of the text's words, up to one in ``DENSE``."""
    return np.where(keys & 1, np.minimum(1.0, DENSE * times / np.maximum(n_words, 1)), 1.0)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, offsets, data in slices(batches):
        row, key, n_words = _marks(offsets, data)
        order = np.argsort(row, kind="stable")
        key, at = key[order], np.searchsorted(row[order], np.arange(rows.num_rows + 1))
        keys, values = [], []
        for i in range(rows.num_rows):
            own, times = np.unique(key[at[i] : at[i + 1]], return_counts=True)
            keys.append(own)
            values.append(_values(own, times, n_words[i]).astype(np.float32))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "grade", "keys", "values"])


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sums(to: np.ndarray, of: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of weights[of] * values by ``to``, a stretch of entries at a time."""
    total = np.zeros(n)
    for i in range(0, len(to), STRETCH):
        total += np.bincount(to[i : i + STRETCH], weights[of[i : i + STRETCH]] * values[i : i + STRETCH], n)
    return total


def fit_arrays(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_columns: int, grades: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by proximal Adam; rows, columns and values list the entries that are not 0."""
    n, top = len(grades), int(grades.max())
    w = np.zeros(n_columns)
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))
    params = np.concatenate([w, theta])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, theta = params[:n_columns], np.sort(params[n_columns:])
        eta = _sums(rows, columns, values, w, n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = logistic(edges[grades + 1] - eta), logistic(edges[grades] - eta)
        p = np.maximum(high - low, 1e-9)
        d_eta = 1 - high - low
        d_theta = np.array([(low * (1 - low) / p)[grades == k + 1].sum() - (high * (1 - high) / p)[grades == k].sum() for k in range(top)])
        gradient = np.concatenate([_sums(columns, rows, values, d_eta, n_columns), d_theta]) / n
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        rate = 0.1 * (1 - 0.5 * t / steps)
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        params = params - step * m / (1 - 0.9**t)
        params[:n_columns] = np.sign(params[:n_columns]) * np.maximum(np.abs(params[:n_columns]) - np.minimum(step[:n_columns] * l1, 0.1), 0)
    return params[:n_columns], np.sort(params[n_columns:])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, sample_features: int = 8 << 20, min_docs: int = 4, l1: float = 2e-4, steps: int = 200) -> Model:
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(0)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(grade).alias("grade"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    features = written(rows.select("doc_id", "grade", "text").mapInArrow(_features, "doc_id long, grade int, keys array<long>, values array<float>"))
    sizes = features.groupBy("doc_id").agg(F.sum(F.size("keys")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # sample_rows numbers
    ids, left = [], sample_features
    for doc_id, n in zip(sizes["doc_id"].to_pylist(), sizes["n"].to_pylist(), strict=True):
        if n <= left:
            ids.append(doc_id)
            left -= n
    chosen = features if len(ids) == sizes.num_rows else features.where(F.col("doc_id").isin(ids))
    # Keys of enough documents are found and numbered in tasks; the driver gets numbers, a part at a time.
    known_keys = chosen.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key")
    keys = np.sort(known_keys.toArrow()["key"].to_numpy().astype(np.int64))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    entries = [_entries(chosen.where(part == i).mapInArrow(lambda it: _numbered(it, keys), "doc_id long, grade int, places array<int>, values array<float>").toArrow().sort_by("doc_id")) for i in range(PARTS)]
    drop(features)
    before = np.cumsum([0, *(len(e[0]) for e in entries)])
    at = np.concatenate([e[1] + np.int32(b) for e, b in zip(entries, before[:-1], strict=True)])
    grades, place, values = (np.concatenate([e[i] for e in entries]) for i in (0, 2, 3))
    del entries
    if not len(keys) or not (grades > 0).any() or not (grades == 0).any():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(1, np.inf))
    levels, grades = np.unique(grades, return_inverse=True)
    weights, thetas = fit_arrays(at, place, values, len(keys), grades, l1, steps)
    del at, place, values
    release()
    return Model(keys[weights != 0], weights[weights != 0], thetas, levels)


def _numbered(batches: Iterable[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys by their places in ``keys``; others are left out."""
    for batch in batches:
        lists = batch.column(2)
        flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        place = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0)).astype(np.int32)
        ok = keys[place] == flat if len(keys) else np.zeros(len(flat), bool)
        ends = np.append(0, np.cumsum(np.bincount(row[ok], minlength=len(lists)))).astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place[ok], batch.column(3).flatten().to_numpy()[ok])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "grade", "places", "values"])


def _entries(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grades, row of each entry, its place, its value)."""
    part = part.combine_chunks()
    if not part.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    places, values = part["places"].combine_chunks(), part["values"].combine_chunks()
    row = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(places.offsets.to_numpy()))
    return part["grade"].to_numpy().astype(np.int64), row, places.flatten().to_numpy(), values.flatten().to_numpy()


def _score(batches: Iterable[pa.RecordBatch], model: Model, cut: float) -> Iterator[pa.RecordBatch]:
    keys = np.append(model.keys, np.int64(0))
    n_keys, steps = len(model.keys), np.diff(model.levels).astype(np.float64)
    for rows, offsets, data in slices(batches):
        row, key, n_words = _marks(offsets, data)
        place = np.searchsorted(model.keys, key)
        hit = np.flatnonzero((keys[place] == key) & (place < n_keys))
        pair, times = np.unique(row[hit] * (n_keys + 1) + place[hit], return_counts=True)
        of, what = pair // (n_keys + 1), pair % (n_keys + 1)
        eta = np.bincount(of, model.weights[what] * _values(model.keys[what], times, n_words[of]), rows.num_rows) if len(pair) else np.zeros(rows.num_rows)
        above = logistic(eta[:, None] - model.thetas)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(above @ steps), pa.array(above[:, 0]), pa.array(model.levels[(above >= 0.5).sum(1)].astype(np.int32)), pa.array(above[:, 0] >= cut)],
            names=["doc_id", "expected_severity", "p_toxic", "grade", "toxic"],
        )


def score(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade, toxic."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _score(it, model, cut), SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **how) -> DataFrame:
    return score(docs, fit(docs, labels, **how), cut)


def keep_clean(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    schema, text = docs.schema, docs.columns.index("text")

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text)], names=["doc_id", "text"])
            clean = [~x.column(4).to_numpy(zero_copy_only=False) for x in _score([pair], model, cut)]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, bool)))

    return docs.mapInArrow(kept, schema)
