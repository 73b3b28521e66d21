"""Queries over large tables: the step that holds an object's rows gets a bounded part of the table."""

import re

import pytest
from pyspark.sql import functions as F

from siltbed.operators import quota
from siltbed.plans import registry
from siltbed.sources import tables

from .compare import same
from .conftest import SF

NAMES = "e01_coalesce_mapped w04_coalesce e14_newest_ranges w01_top_rule j03_quota_check d10_release_checked d11_stage e05_release d11_stage_checked d10_release e17_exclusive_zones e03_remove".split()


@pytest.mark.parametrize("name", NAMES)
def test_dealt_by_rows(spark, duck, monkeypatch, name):
    monkeypatch.setattr(tables, "TASK_ROWS", 512)
    monkeypatch.setattr(tables, "LARGE_ROWS", 1000)
    got = registry.QUERIES[name](spark, SF)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    same(got, duck.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["w04_coalesce", "e05_release", "e03_remove"])
@pytest.mark.parametrize("rows", [1024, 256])
def test_a_task_has_no_more_of_a_larger_table(spark, monkeypatch, name, rows):
    """There are as many tasks as the table has lots of rows, and none has twice its share of the result."""
    monkeypatch.setattr(tables, "TASK_ROWS", rows)
    monkeypatch.setattr(tables, "LARGE_ROWS", 1000)
    got = registry.QUERIES[name](spark, SF)
    made = [r.n for r in got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert len(made) == -(-tables.Tables(spark, SF).raw("lineitem").count() // rows)
    assert max(made) < 2 * sum(made) / len(made)


@pytest.mark.parametrize("name", ["w04_coalesce", "e05_release", "e03_remove"])
def test_lines_are_spread_before_many_tasks(spark, duck, monkeypatch, name):
    """A task that reads deals to few tasks, so that Spark writes each row at once; those deal to many."""
    monkeypatch.setattr(tables, "TASK_ROWS", 256)
    monkeypatch.setattr(tables, "LARGE_ROWS", 1000)
    monkeypatch.setattr(tables, "AT_ONCE", 5)
    got = registry.QUERIES[name](spark, SF)
    steps = re.findall(r"Exchange \w+\(.*, (\d+)\), |(FileScan)", got._jdf.queryExecution().executedPlan().toString())
    many = -(-tables.Tables(spark, SF).raw("lineitem").count() // 256)
    reads = [i for i, (_, scan) in enumerate(steps) if scan]
    assert reads and all([n for n, _ in steps[i - 2 : i]] == [str(many), "5"] for i in reads)
    same(got, duck.execute(registry.ORACLE_SQL[name]).df())


def test_moved_blocks_are_dealt_again(spark, duck, monkeypatch):
    """What stays and what is moved are joined up in as many tasks as the lines have lots, not as Spark has cores."""
    monkeypatch.setattr(tables, "TASK_ROWS", 512)
    monkeypatch.setattr(tables, "LARGE_ROWS", 1000)
    got = registry.QUERIES["d12_move_blocks"](spark, SF)
    lots = -(-tables.Tables(spark, SF).raw("lineitem").count() // 512)
    assert got.select(F.spark_partition_id().alias("task")).distinct().count() == lots
    same(got, duck.execute(registry.ORACLE_SQL["d12_move_blocks"]).df())


def test_inputs_of_one_total_do_not_meet_in_one_task(spark):
    """Every input but two asks for the same total, some for none: no task of the check's joins and groups reads most inputs."""
    rules = spark.createDataFrame([(9, 7, "U", "S", 1, "L", "-", 0, "L", "-", "I", 3, "C"), (1, 1, "L", "-", 1, "L", "-", 0, "L", "-", "I", 900, "C")], "prio long, v0 long, s0 string, f0 string, v1 long, s1 string, f1 string, v2 long, s2 string, f2 string, op string, lim long, rflag string")
    inputs = spark.range(1000).select(F.col("id").alias("req"), F.lit(0).cast("long").alias("proj"), F.when(F.col("id") < 2, 7).otherwise(8).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"), F.when(F.col("id") % 10 == 9, "D").otherwise("I").alias("op"))
    totals = spark.createDataFrame([(1, 1, 0, 5, 900), (7, 1, 0, 5, 2)], "a long, b long, c long, total long, count long")
    met = []
    got = quota.check(inputs, rules, totals, 100, lambda named: met.append(named.count()) or named)
    assert met == [2]  # only those are dealt by name
    assert {r.req: r.denied for r in got.collect()} == {i: i > 1 and i % 10 != 9 for i in range(1000)}


def test_checked_moves_read_the_lines_once(spark, duck, monkeypatch):
    """Extents, objects, moves and their pieces are written: the plan of the result has no line or order in it."""
    monkeypatch.setattr(tables, "TASK_ROWS", 512)
    monkeypatch.setattr(tables, "LARGE_ROWS", 1000)
    got = registry.QUERIES["d12_move_checked"](spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    same(got, duck.execute(registry.ORACLE_SQL["d12_move_checked"]).df())
