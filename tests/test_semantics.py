"""Pinned cases: totals step by step, quota rules, index bounds, extents against a model of blocks."""

import random

import pytest
from pyspark.sql import functions as F

from siltbed.functions import hashing, parsing
from siltbed.operators import extents, forest, index, quota, search, totals, tree

EXT = "ino long, start long, len long, map long, flags long"


def deltas(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, c long, total long, count long")


def total(spark, rows):
    return sorted(tuple(r) for r in totals.combine(deltas(spark, rows)).collect())


def test_totals_step_by_step(spark):
    log = [(1, 2, 3, 1, 1), (4, 5, 6, 1, 1)]
    assert total(spark, log) == [(1, 2, 3, 1, 1), (4, 5, 6, 1, 1)]
    log += [(1, 2, 3, 1, 1), (4, 5, 6, 1, 1)]
    assert total(spark, log) == [(1, 2, 3, 2, 2), (4, 5, 6, 2, 2)]
    log += [(4, 5, 6, -1, -1), (1, 2, 3, 9, 0)]
    assert total(spark, log) == [(1, 2, 3, 11, 2), (4, 5, 6, 1, 1)]
    log += [(1, 2, 3, -1, -1), (4, 5, 6, -1, -1)]
    assert total(spark, log) == [(1, 2, 3, 10, 1)]
    log += [(1, 2, 3, -10, -1)]
    assert total(spark, log) == []


def test_zero_total_with_count_survives(spark):
    assert total(spark, [(1, 1, 1, 5, 1), (1, 1, 1, -5, 0)]) == [(1, 1, 1, 0, 1)]


def test_merge_counts_input_once(spark):
    schema = "a long, b long, c long, total long, count long, seq long, bucket string"
    cases = {
        1: [("fs", 5, 1, 10), ("input", 3, 1, 11), ("log", 2, 1, 1)],  # newer input counts
        2: [("fs", 8, 2, 12), ("input", 3, 1, 11), ("log", 2, 1, 1)],  # already in the base
        3: [("input", 3, 1, 11)],  # creates
        4: [("input", -3, -1, 11), ("log", 1, 1, 5)],  # merged and deleted in the base
    }
    rows = [(k, 0, 0, t, c, s, b) for k, v in cases.items() for b, t, c, s in v]
    got = {r.a: (r.total, r["count"]) for r in totals.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (10, 3), 2: (10, 3), 3: (3, 1), 4: (1, 1)}


def test_newest_prefers_base_on_ties(spark):
    log = spark.createDataFrame([(1, 5, False, 1.0, "log"), (1, 5, False, 2.0, "base"), (2, 1, False, 1.0, "base"), (2, 2, True, None, "log")], "key long, seq long, is_delete boolean, val double, source string")
    assert [(r.key, r.val) for r in forest.newest(log, ["key"]).collect()] == [(1, 2.0)]


def test_third_toggle_reappears(spark):
    log = spark.createDataFrame([(1, 1, 1)] * 3 + [(1, 2, 1)] * 2, "hash long, ino long, id long")
    assert [r.ino for r in search.candidates(log, 1, 0, 10).collect()] == [1]


def test_index_bounds(spark):
    rows = spark.createDataFrame([(0, 0, 1, 1), (255, 9, 2, 1), (255, 9, 2, 2)], "major long, minor long, ino long, xid long")
    assert index.read_index(rows, (0, 0, 0), (255, 10, 0)).count() == 2
    with pytest.raises(ValueError):
        index.read_index(rows, (1, 0, 0), (0, 0, 0))
    with pytest.raises(ValueError):
        index.walk(rows, "size", (0, 0, 0), (1, 0, 0))


RULE = "prio long, v0 long, s0 string, f0 string, v1 long, s1 string, f1 string, v2 long, s2 string, f2 string, op string, lim long, rflag string"


def denied(spark, rules, tot, uid=5, gid=6, op="I"):
    inputs = spark.createDataFrame([(1, 0, uid, gid, op)], "req long, proj long, uid long, gid long, op string")
    t = spark.createDataFrame(tot, "a long, b long, c long, total long, count long")
    return quota.check(inputs, spark.createDataFrame(rules, RULE), t).first().denied


def test_quota_cases(spark):
    default = (1, 1, "L", "-", 1, "L", "-", 1, "L", "-", "I", 1, "-")
    uid = (1, 5, "U", "S", 1, "L", "-", 1, "L", "-", "I", 1, "-")
    both = (1, 5, "U", "S", 6, "G", "S", 1, "L", "-", "I", 1, "-")
    assert denied(spark, [default], [(1, 1, 1, 2, 1)])
    assert not denied(spark, [default], [(9, 9, 9, 2, 1)])
    assert denied(spark, [uid], [(5, 1, 1, 2, 1)])
    assert not denied(spark, [both], [(5, 6, 1, 2, 1)], gid=7)
    assert denied(spark, [both], [(5, 6, 1, 2, 1)])
    assert not denied(spark, [(*uid[:10], "D", 1, "-")], [(5, 1, 1, 2, 1)])
    assert denied(spark, [(1, *uid[1:11], 1000, "-"), (2, *uid[1:])], [(5, 1, 1, 2, 1)])
    assert denied(spark, [(*default[:10], "D", 0, "C")], [(1, 1, 1, 0, 1)], op="D")


def test_rule_text_round_trip(spark):
    rules = spark.createDataFrame([(1, 5, "U", "S", 1, "L", "-", 1, "L", "-", "I", 1, "C")], RULE)
    assert tuple(quota.from_text(quota.to_text(rules)).select(*rules.columns).first()) == tuple(rules.first())
    assert quota.from_text(spark.createDataFrame([("1 x",)], "rule string")).first().prio is None


def test_selecting_literal_is_invalid(spark):
    assert not quota.valid(spark.createDataFrame([(1, 5, "L", "S", 1, "L", "-", 1, "L", "-", "I", 1, "C")], RULE)).first().is_valid


def blocks(rows):
    return {(i, s + k): (m + k if m else 0, f) for i, s, n, m, f in rows for k in range(n)}


def joined(model):
    out = []
    for (i, b), (m, f) in sorted(model.items()):
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] == b and out[-1][4] == f and (m == out[-1][3] + out[-1][2] if m and out[-1][3] else m == out[-1][3]):
            out[-1][2] += 1
        else:
            out.append([i, b, 1, m, f])
    return [tuple(x) for x in out]


def random_extents(seed, n=60):
    r, rows = random.Random(seed), []
    for ino in range(1, n + 1):
        at = r.randrange(3)
        for _ in range(r.randrange(1, 6)):
            size, flag = r.randrange(1, 6), r.choice([0, 0, 1, 2])
            rows.append((ino, at, size, 0 if flag == 1 else 100 + at + r.choice([0, 0, 50]), flag))
            at += size + r.choice([0, 0, 0, 2])
    ranges = [(i, a := r.randrange(0, 12), a + r.randrange(1, 9)) for i in range(1, n + 1, 1)]
    return rows, ranges


@pytest.mark.parametrize("seed", range(3))
def test_extent_operators_match_blocks(spark, seed):
    rows, ranges = random_extents(seed)
    e, r = spark.createDataFrame(rows, EXT), spark.createDataFrame(ranges, "ino long, first long, end long")
    hit = {(i, b) for i, a, z in ranges for b in range(a, z)}
    first = {i: a for i, a, _ in ranges}
    model = blocks(rows)
    got = lambda df: sorted(tuple(x) for x in df.select(*extents.COLUMNS).collect())
    assert got(extents.coalesce(e)) == joined(model)
    assert got(extents.release(e, r)) == joined({k: (0, 1) if k in hit else v for k, v in model.items()})
    assert got(extents.coalesce(extents.remove(e, r))) == joined({k: v for k, v in model.items() if k not in hit})
    staged = {k: (900 + k[1] - first[k[0]], 0) if k in hit and v[1] == 1 else v for k, v in model.items()}
    assert got(extents.stage(e, r.withColumn("to_map", F.lit(900).cast("long")))) == joined(staged)
    refused = {i for (i, b), v in model.items() if (i, b) in hit and v[0]}
    assert got(extents.punch_offline(e, r)) == joined({k: v for k, v in model.items() if not (k in hit and v[1] == 1 and k[0] not in refused)})


def test_release_matrix(spark):
    """A file of five blocks at 100, three single releases: 125 orders."""
    rows = [(25 * a + 5 * b + c, 0, 5, 100, 0) for a in range(5) for b in range(5) for c in range(5)]
    e = spark.createDataFrame(rows, EXT)
    for part in (25, 5, 1):
        once = e.select("ino").distinct().select("ino", F.expr(f"ino div {part} % 5").alias("first"), F.expr(f"ino div {part} % 5 + 1").alias("end"))
        e = spark.createDataFrame(extents.release(e, once).collect(), EXT)
    got = {}
    for r in e.orderBy("ino", "start").collect():
        got.setdefault(r.ino, []).append((r.start, r.map, r.len))
    assert got[1] == [(0, 0, 2), (2, 102, 3)]  # 0 0 1
    assert got[2] == [(0, 0, 1), (1, 101, 1), (2, 0, 1), (3, 103, 2)]  # 0 0 2
    for ino in range(125):
        off = {ino // 25, ino // 5 % 5, ino % 5}
        assert [tuple(x) for x in joined({(ino, b): (0, 1) if b in off else (100 + b, 0) for b in range(5)})] == [(ino, s, n, m, int(m == 0)) for s, m, n in got[ino]]


def test_paths_and_cycles(spark):
    d = spark.createDataFrame([(2, 1, "a"), (4, 2, "b"), (9, 4, "c")], "ino long, dir_ino long, name string")
    assert {r.ino: r.path for r in tree.paths(d).collect()} == {2: "/a", 4: "/a/b", 9: "/a/b/c"}
    with pytest.raises(ValueError):
        tree.ancestors(spark.createDataFrame([(2, 3, "a"), (3, 2, "b")], "ino long, dir_ino long, name string"))


def test_hard_links_have_a_path_each(spark):
    rows = [(2, 1, 5, "a"), (3, 1, 7, "b"), (9, 2, 1, "x"), (9, 3, 4, "y"), (9, 3, 8, "z"), (4, 3, 2, "c")]
    d = spark.createDataFrame(rows, "ino long, dir_ino long, pos long, name string")
    got = {(r.ino, r.dir_ino, r.pos): r.path for r in tree.paths(d).collect()}
    assert got == {(2, 1, 5): "/a", (3, 1, 7): "/b", (9, 2, 1): "/a/x", (9, 3, 4): "/b/y", (9, 3, 8): "/b/z", (4, 3, 2): "/b/c"}
    cursors = [(9, 0, 0), (9, 2, 2), (9, 3, 5), (9, 3, 9), (5, 0, 0)]
    after = tree.next_path(d, spark.createDataFrame(cursors, "ino long, dir_ino long, pos long"))
    assert {(r.from_dir, r.from_pos): r.path for r in after.collect()} == {(0, 0): "/a/x", (2, 2): "/b/y", (3, 5): "/b/z"}
    assert {(r.ancestor, r.depth) for r in tree.ancestors(d).where("ino = 9").collect()} == {(9, 0), (2, 1), (3, 1), (1, 2)}
    moves = spark.createDataFrame([(3, 4), (2, 4), (3, 3), (4, 1)], "ino long, to_dir long")
    assert {(r.ino, r.to_dir): r.allowed for r in tree.rename_allowed(d, moves).collect()} == {(3, 4): False, (2, 4): True, (3, 3): False, (4, 1): True}


def test_depth_has_no_limit_and_cycles_are_found_deep(spark):
    deep = [(k + 1, k, 2, str(k)) for k in range(1, 501)]
    d = spark.createDataFrame(deep, "ino long, dir_ino long, pos long, name string")
    longest = tree.paths(d).where("ino = 501").first().path
    assert longest == "".join(f"/{k}" for k in range(1, 501))
    lost = spark.createDataFrame([(1000, 999, 2, "lost")], d.schema)
    assert tree.paths(d.unionByName(lost)).where("ino = 1000").count() == 0
    ring = spark.createDataFrame([(700 + k, 700 + (k + 1) % 90, 2, "r") for k in range(90)], d.schema)
    with pytest.raises(ValueError):
        tree.paths(d.unionByName(ring))


def test_hashes():
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325
    assert hashing.fnv1a(b"a", 32) == 0xE40C292C
    assert hashing.crc32c(b"123456789") == 0xE3069283


def test_hash_columns(spark):
    row = spark.createDataFrame([("a",), (None,)], "n string").select(hashing.fnv1a_64("n").alias("a"), hashing.fnv1a_32("n").alias("b"), hashing.crc32c_of("n").alias("c")).collect()
    assert int(row[0].a) == hashing.fnv1a(b"a") and row[0].b == 0xE40C292C and row[1].a is None and row[1].c is None


def test_tags(spark):
    names = ["archive.totl.a", "archive.hide.srch.x", "archive.x", "user.totl.a", "archive.totlx.a"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(parsing.tag_run(F.col("n")).alias("t"), parsing.invalid_tags(F.col("n")).alias("i"), parsing.has_tag(F.col("n"), "srch").alias("s")).collect()
    assert [tuple(r) for r in got] == [("totl.", False, False), ("hide.srch.", False, True), ("", True, False), ("", False, False), ("", True, False)]
