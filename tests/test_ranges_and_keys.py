"""Ranges against a model of blocks, guarded moves, cursors, bitmaps, names and numbers."""

import random

import pytest
from pyspark.sql import functions as F

from siltbed.functions import hashing, parsing
from siltbed.operators import extents, forest, index

from .conftest import SF

EXT = "ino long, start long, len long, map long, flags long"
RANGE = "ino long, first long, end long, read_seq long"


@pytest.mark.parametrize("seed", [1, 2])
def test_newest_ranges_match_blocks(spark, seed):
    rng = random.Random(seed)
    rows = []
    for ino in range(1, 8):
        for seq in rng.sample(range(100), rng.randint(1, 6)):
            first = rng.randint(0, 20)
            rows.append((ino, first, first + rng.randint(1, 8), seq))
    owner = {}
    for ino, first, end, seq in rows:
        for blk in range(first, end):
            owner[ino, blk] = max(owner.get((ino, blk), -1), seq)
    got = extents.newest_ranges(spark.createDataFrame(rows, RANGE)).collect()
    assert {(r.ino, blk): r.read_seq for r in got for blk in range(r.first, r.end)} == owner
    assert sum(r.end - r.first for r in got) == len(owner)


def test_older_range_inside_newer_is_dropped(spark):
    rows = [(1, 0, 10, 5), (1, 2, 4, 3), (2, 0, 4, 1), (2, 2, 8, 2), (2, 2, 8, 2)]
    got = sorted(tuple(r) for r in extents.newest_ranges(spark.createDataFrame(rows, RANGE)).select("ino", "first", "end", "read_seq").collect())
    assert got == [(1, 0, 10, 5), (2, 0, 2, 1), (2, 2, 8, 2)]
    assert extents.newest_ranges(spark.createDataFrame([], RANGE)).count() == 0


def test_move_needs_an_empty_target(spark):
    there = spark.createDataFrame([(1, 0, 4, 100, 0), (2, 2, 2, 300, 0), (3, 0, 4, 500, 0)], EXT)
    moves = spark.createDataFrame([(1, 2, 0, 2, 0), (3, 2, 0, 2, 1)], "ino long, to_ino long, first long, end long, to_first long")
    got = sorted(tuple(r) for r in extents.move_blocks(there, moves).collect())
    # Object 1 fits before block 2 of object 2; object 3 would touch it.
    assert got == [(1, 2, 2, 102, 0), (2, 0, 2, 100, 0), (2, 2, 2, 300, 0), (3, 0, 4, 500, 0)]


def test_coverage(spark):
    there = spark.createDataFrame([(1, 0, 3, 10, 0), (1, 3, 3, 13, 2), (2, 0, 3, 10, 0), (2, 4, 3, 14, 0)], EXT)
    ranges = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 0, 1)], "ino long, first long, end long")
    got = {r.ino: (r.covered, r.dirty) for r in extents.covered(there, ranges).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False)}


def test_pages_resume_after_the_last_key(spark):
    rows = spark.createDataFrame([(k // 3, k) for k in range(10)], "major long, ino long")
    got = index.pages(rows, ["major", "ino"], 4, 5)
    assert sorted((r.page, r.ino) for r in got.collect()) == [(k // 4, k) for k in range(10)]
    assert index.pages(rows.where("ino < 0"), ["major", "ino"], 4, 3).count() == 0


def test_bitmap_words(spark):
    rows = spark.createDataFrame([(0,), (0,), (31,), (32,), (65,)], "ino long")
    got = {r.word: (r.bits, r.n_set) for r in index.bitmap(rows, [], F.col("ino")).collect()}
    assert got == {0: (1 + 2**31, 2), 1: (1, 1), 2: (2, 1)}


def test_no_finalized_key_gives_no_row(spark):
    log = spark.createDataFrame([(5, 10), (9, 20)], "key long, finalize_seq long")
    assert [r.key for r in index.next_finalized(log, 15, 0, 9).collect()] == [5]
    assert index.next_finalized(log, 10, 0, 9).count() == 0


def test_last_option_change_decides(spark):
    rows = [(1, 1, "set", 7), (1, 2, "clear", 0), (2, 2, "set", 8), (2, 1, "clear", 0), (3, 1, "set", 1), (3, 2, "set", 2)]
    got = forest.options(spark.createDataFrame(rows, "bit long, seq long, op string, value long"))
    assert sorted(tuple(r) for r in got.collect()) == [(2, 8), (3, 2)]


def test_sorted_runs_keep_every_row(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("key"), F.col("id").alias("seq")).unionByName(spark.range(3).select(F.lit(5).cast("long").alias("key"), F.lit(5).cast("long").alias("seq")))
    assert sorted(map(tuple, forest.sorted_runs(rows, ["key", "seq"]).collect())) == sorted(map(tuple, rows.collect()))


def test_fingerprint_keeps_the_order_of_names():
    assert hashing.fingerprint(b"a") == 0x61 << 24
    assert hashing.fingerprint(b"abcd") == int.from_bytes(b"abcd", "big")
    names = [b"", b"a", b"ab", b"abcd", b"b", b"zz"]
    prints = [hashing.fingerprint(n) for n in names]
    assert prints == sorted(prints)
    assert 0 <= hashing.fingerprint(b"x" * 255) < 2**32


def test_positions(spark):
    texts = ["1", "1.2", "1.2.3", "0x10.0.5", "", "1.", "1.2.3.4", "1.b"]
    major, minor, ino = parsing.position(F.col("t"))
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[c.cast("long").alias(n) for c, n in zip((major, minor, ino), "abc")])
    got = {r.t: (r.a, r.b, r.c) for r in rows.collect()}
    none = (None, None, None)
    assert got == {"1": (1, 0, 0), "1.2": (1, 2, 0), "1.2.3": (1, 2, 3), "0x10.0.5": (16, 0, 5), "": none, "1.": none, "1.2.3.4": none, "1.b": none}


def test_packed_keys_sort_like_tuples(spark):
    rng = random.Random(3)
    keys = [(rng.randint(0, 255), rng.randint(0, 2**62), rng.randint(1, 2**62)) for _ in range(200)]
    df = spark.createDataFrame(keys, "a long, b long, c long").select(parsing.packed_key([F.col(x) for x in "abc"], [2, 16, 16]).alias("k"))
    back = df.orderBy("k").select(*parsing.unpacked_key(F.col("k"), [2, 16, 16])).collect()
    assert [tuple(map(int, r)) for r in back] == sorted(keys)


def test_pages_cover_the_whole_feed(spark):
    rows = spark.createDataFrame([(k // 3, k) for k in range(1000)], "major long, ino long").repartition(7)
    got = index.all_pages(rows, ["major", "ino"], 4)
    assert sorted((r.page, r.ino) for r in got.collect()) == [(k // 4, k) for k in range(1000)]
    few = index.pages(rows, ["major", "ino"], 4, 3)
    assert sorted(few.collect()) == sorted(got.where("page < 3").select(*few.columns).collect())
    assert index.all_pages(rows.where("ino < 0"), ["major", "ino"], 4).count() == 0


def test_merged_runs_keep_every_hash(spark):
    from siltbed.plans import registry
    from siltbed.sources.tables import Tables

    from .conftest import SF

    got = registry.QUERIES["o01_merge_whole_runs"](spark, SF)
    log = Tables(spark, SF).srch_log()
    assert got.count() == log.count() and got.select("hash").distinct().count() == 10


def test_deep_trees_are_whole(spark):
    from siltbed.operators import tree

    chain = spark.createDataFrame([(k + 1, k) for k in range(1, 100)], "ino long, dir_ino long")
    got = tree.ancestors(chain)
    assert got.count() == sum(k + 1 for k in range(1, 100)) and got.agg(F.max("depth")).first()[0] == 99
    with pytest.raises(ValueError):
        tree.ancestors(chain.unionByName(spark.createDataFrame([(1, 50)], "ino long, dir_ino long")))


def test_each_object_has_its_own_bit(spark):
    from siltbed.plans import registry

    from .conftest import SF

    got = registry.QUERIES["p21_inode_bit"](spark, SF)
    assert got.select("grp", "bit").distinct().count() == got.select("ino").distinct().count() and got.where("ino <> grp * 1024 + bit").count() == 0


def test_overlapping_locks_scan_no_frame_for_each_row(spark):
    """A frame that ends with the partition is read again for each row; the one that begins with it is not."""
    from siltbed.plans import registry

    plan = registry.QUERIES["e18_overlapping_locks"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "unboundedfollowing" not in plan.lower()
