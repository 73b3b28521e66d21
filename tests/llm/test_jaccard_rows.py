"""The join on rows that share ids, have none, or are many copies; blocks at any number of parts."""

import random
import time

import numpy as np
import pyarrow as pa

from siltbed.llm import blocks, jaccard

from .test_text_operators import LOW, WORD

SCHEMA = "doc_id long, text string"


def brute_rows(rows, share=80):
    """(doc_id, n_shingles, component_id) of each row, every row a document of its own."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= share * (len(sets[a]) + len(sets[b]) - k):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    return [(doc, len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def same_rows(spark, rows, **how):
    got = jaccard.components(spark.createDataFrame(rows, SCHEMA), **how).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got], key=order) == sorted(brute_rows(rows), key=order)


def test_texts_without_words_stand_alone(spark):
    long = " ".join(f"w{i}" for i in range(24))
    same_rows(spark, [(4, None), (4, long), (9, ""), (10, None), (11, "a b"), (None, long), (None, ""), (None, "x y z"), (12, "X  y z")])


def test_repeated_ids_are_documents_of_their_own(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(300)}" for _ in range(r.randrange(6, 40))] for _ in range(10)]
    rows = []
    for _ in range(200):
        w = list(r.choice(base))
        if r.random() < 0.5:
            w[r.randrange(len(w))] = f"w{r.randrange(300)}"
        rows.append((r.choice([None, *range(60)]), " ".join(w)))
    rows += rows[:30]
    same_rows(spark, rows, chunk_bytes=3000, part_keys=400)


def test_long_lists_are_paired_in_shares(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARE_ROWS", 7)
    monkeypatch.setattr(jaccard, "SALTS", 4)
    r = random.Random(8)
    passage = [f"p{i}" for i in range(14)]
    rows = [(i, " ".join([*passage, *(f"u{i // r.choice([1, 2, 3])}x{j}" for j in range(r.randrange(0, 4)))])) for i in range(120)]
    same_rows(spark, rows, chunk_bytes=3000, part_keys=400)


def test_blocks_round_trip_at_any_number_of_parts():
    r = np.random.default_rng(1)
    for bits in (40, 64):
        keys = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.uint64) >> np.uint64(63 - bits + 1) if bits < 64 else r.integers(0, 1 << 63, 3000, dtype=np.uint64))
        counts = r.integers(1, 9, len(keys))
        for parts in (1, 7, 1000, 1_000_000):
            t = blocks.split(3, 1, keys, counts, parts, bits)
            steps, sizes = blocks.unpack(t["keys"], np.uint64)
            assert (blocks._sums_within(steps, sizes) == keys).all() and (blocks.unpack(t["counts"], np.uint32)[0] == counts).all()
            part = np.repeat(t["part"].to_numpy(), sizes)
            assert (np.diff(part) >= 0).all() and part.max() < parts
            twice = blocks.add_part(pa.concat_tables([t, t.slice(1)])) if parts == 7 else None
            if twice is not None:
                assert blocks.unpack(twice["totals"], np.uint64)[0].sum() > 2 * counts.sum()
    keys = np.unique(r.integers(0, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2))
    blocks.split(0, 1, keys[:10], np.ones(10, np.int64), 5)
    begin = time.perf_counter()
    blocks.split(0, 1, keys, np.ones(len(keys), np.int64), 1_000_000)
    assert time.perf_counter() - begin < 0.5
    assert blocks.split(0, 1, keys[:0], np.ones(0, np.int64), 5).num_rows == 0
