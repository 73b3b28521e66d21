"""Stream state across restarts, scratch tables, many quota rules, attribute rules, ranges cut from extents."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siltbed.operators import attributes, extents, forest, quota, search
from siltbed.sources import scratch
from siltbed.streaming import feed

LOG = "key long, seq long, is_delete boolean, val double, source string"


def test_state_is_found_again_and_rewritten_in_touched_buckets(spark, tmp_path):
    files, state = str(tmp_path / "in"), str(tmp_path / "state")

    def add(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(files)

    def follow():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(files)
        return sorted((r.key, r.seq, r.val) for r in feed.newest_by_stream(stream, ["key"], state).collect())

    add([(k, 10, False, 1.0, "log") for k in range(200)])
    add([(1, 11, False, 2.0, "log"), (2, 9, False, 3.0, "log"), (3, 12, True, 0.0, "log")])
    want = sorted((k, 11 if k == 1 else 10, 2.0 if k == 1 else 1.0) for k in range(200) if k != 3)
    assert follow() == want
    assert follow() == want  # nothing new: the state is still there
    add([(1, 5, False, 9.0, "log"), (3, 13, False, 4.0, "log")])
    want = sorted([x for x in want if x[0] != 3] + [(3, 13, 4.0)])
    assert follow() == want
    versions = feed._versions(spark, state)
    touched = [b for b, v in versions.items() if len(v) > 1]
    assert 1 <= len(touched) <= 4 and all(len(v) <= 2 for v in versions.values()) and len(versions) > 20


def test_cleared_scratch_tables_are_gone(spark):
    df = scratch.written(spark.range(10))
    path = df._scratch_path
    assert os.path.isdir(path)
    scratch.clear(spark)
    assert not os.path.exists(path) and not os.path.exists(os.path.dirname(path))
    assert scratch.written(spark.range(3)).count() == 3


def brute_match(inp, rules):
    def part(r, i):
        return inp[{"P": 1, "U": 2, "G": 3}[r[3 * i + 2]]] if r[3 * i + 2] != "L" else r[3 * i + 1]

    def rank(r):
        out = [r[0]]
        for i in range(3):
            out += [r[3 * i + 1], quota.SOURCE_CODE[r[3 * i + 2]], r[3 * i + 3] == "S"]
        return [*out, r[10] == "D", r[11], r[12] == "C"]

    ok = [r for r in rules if r[10] == inp[4] and all(r[3 * i + 3] != "S" or part(r, i) == r[3 * i + 1] for i in range(3))]
    best = max(ok, key=rank, default=None)
    return best and (part(best, 0), part(best, 1), part(best, 2), best[11])


def test_many_rules_are_looked_up_by_a_selected_value(spark):
    r = random.Random(2)
    rules = [(r.randrange(5), r.randrange(400), r.choice("PUG"), "S", r.randrange(400), r.choice("LPUG"), "-", r.randrange(40), r.choice("PUG"), r.choice("S-"), r.choice("ID"), i, r.choice("C-")) for i in range(50_001)]
    rules[7:9] = [(9, 1, "L", "-", 2, "L", "-", 3, "L", "-", "I", 5, "-"), (0, 1, "L", "-", 2, "L", "-", 3, "L", "-", "D", 5, "-")]
    inputs = [(i, r.randrange(400), r.randrange(400), r.randrange(400), r.choice("ID")) for i in range(150)]
    table = spark.createDataFrame(rules, "prio long, v0 long, s0 string, f0 string, v1 long, s1 string, f1 string, v2 long, s2 string, f2 string, op string, lim long, rflag string")
    asked = spark.createDataFrame(inputs, "req long, proj long, uid long, gid long, op string")
    out = quota.matches(asked, table)
    got = {x.req: (x.a, x.b, x.c, x.lim) for x in out.collect()}
    assert got == {i[0]: brute_match(i, rules) for i in inputs}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quota.selecting(asked, table)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "probe" in plan or "value" in plan
    assert quota.selecting(asked, table).count() < 150 * 50_001 / 50


def test_search_pages(spark):
    log = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 1), (1, 7, 1), (1, 7, 1)], "hash long, ino long, id long")
    flag = lambda *how: tuple(search.page(log, *how).first())
    assert flag(1, 0, 100, 10, 10) == (3, 2, False)  # 5 is tracked twice
    assert flag(1, 6, 100, 10, 10) == (1, 1, True)
    assert flag(1, 0, 100, 10, 2) == (2, 1, False)  # tracking stopped early
    assert flag(2, 0, 100, 10, 2) == (0, 0, True)


def test_presence_of_any_number_of_runs(spark):
    runs = {f"r{i}": spark.createDataFrame([(k,) for k in range(i, 10, i + 1)], "k long") for i in range(3)}
    got = {x.k: (x.r0, x.r1, x.r2) for x in forest.presence(runs, ["k"]).collect()}
    assert got == {k: (True, k % 2 == 1, k % 3 == 2) for k in range(10)}


def test_masks(spark):
    a = spark.createDataFrame([(1, 10, 20, 3), (2, 11, 21, 4)], "ino long, meta_seq long, size long, data_version long")
    ask = spark.createDataFrame([(1, 1 | 128), (2, 4), (2, 1 << 10), (1, 0)], "ino long, mask long")
    got = sorted(tuple(r) for r in attributes.chosen(a, ask).fillna(-1).collect())
    assert got == [(1, -1, -1, -1), (1, 10, -1, 20), (2, -1, 4, -1)]


CHANGES = [
    # is_dir, data_version, flags; mask, change_flags, new_version, new_size, bits -> status
    ((False, 0, 0), (4, 0, 0, 0, 0), "invalid"),
    ((False, 0, 0), (4, 0, 3, 0, 0), "ok"),
    ((False, 2, 0), (4, 0, 3, 0, 0), "invalid"),
    ((True, 0, 0), (4, 0, 3, 0, 0), "invalid"),
    ((False, 0, 0), (128, 0, 0, 5, 0), "invalid"),
    ((False, 0, 0), (128, 0, 0, 0, 0), "ok"),
    ((False, 0, 0), (132, 1, 1, 5, 0), "ok"),
    ((False, 0, 0), (132, 1, 1, 0, 0), "invalid"),
    ((True, 0, 0), (256, 0, 0, 0, 1), "invalid"),
    ((False, 5, 2), (512, 0, 0, 0, 0), "retained"),
    ((False, 5, 2), (256, 0, 0, 0, 1), "retained"),
    ((False, 5, 2), (256 | 512, 0, 0, 0, 0), "ok"),
    ((False, 5, 2), (0, 0, 0, 0, 0), "none"),
]


def test_changes_are_made_whole_or_not_at_all(spark):
    objects = spark.createDataFrame([(i, *o, 7, 1) for i, (o, _, _) in enumerate(CHANGES)], "ino long, is_dir boolean, data_version long, flags long, size long, proj long")
    asked = spark.createDataFrame([(i, *c, 9) for i, (_, c, _) in enumerate(CHANGES)], "ino long, mask long, change_flags long, new_version long, new_size long, bits long, new_proj long")
    for r in attributes.change(objects, asked).collect():
        (_, version, flags), (mask, change_flags, new_version, new_size, bits), want = CHANGES[r.ino]
        assert r.status == want
        ok = want == "ok"
        assert r.data_version == (new_version if ok and mask & 4 else version) and r.size == (new_size if ok and mask & 128 else 7)
        assert r.proj == (9 if ok and mask & 512 else 1) and r.flags == ((flags & ~2 | bits * 2) if ok and mask & 256 else flags)
        assert r.offline_made == (-(-new_size // 4096) if ok and change_flags else 0)


@pytest.mark.parametrize("seed", range(2))
def test_subtract_any_number_of_ranges(spark, seed):
    r = random.Random(seed)
    e, cuts, blocks = [], [], {}
    for ino in range(12):
        at = 0
        for _ in range(r.randrange(1, 5)):
            at, n, m = at + r.randrange(0, 4), r.randrange(1, 12), r.choice([0, 1000 * (ino + 1)])
            e.append((ino, at, n, m and m + at, 0))
            blocks |= {(ino, b): m and m + b for b in range(at, at + n)}
            at += n
        at = 0
        for _ in range(r.randrange(0, 5)):
            at, n = at + r.randrange(0, 5), r.randrange(1, 5)
            cuts.append((ino, at, at + n))
            for b in range(at, at + n):
                blocks.pop((ino, b), None)
            at += n
    out = extents.subtract(spark.createDataFrame(e, "ino long, start long, len long, map long, flags long"), spark.createDataFrame(cuts, "ino long, first long, end long"))
    got = {(x.ino, b): x.map and x.map + b - x.start for x in out.collect() for b in range(x.start, x.start + x.len)}
    assert got == blocks and out.agg(F.sum("len")).first()[0] == len(blocks)
