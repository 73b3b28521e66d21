"""Totals: commutative (total, count) increments of tagged attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = ["a", "b", "c"]


def combine(deltas: DataFrame) -> DataFrame:
    """Sums by name; a name whose total and count are both zero vanishes."""
    return deltas.groupBy(*NAME).agg(F.sum("total").alias("total"), F.sum("count").alias("count")).where("total <> 0 or count <> 0")


def increments(changes: DataFrame) -> DataFrame:
    """What setting an attribute adds: from name, old and new (null: absent)."""
    there = lambda c: F.col(c).isNotNull().cast("long")
    return changes.select(*NAME, (F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("total"), (there("new") - there("old")).alias("count"))


def resolve(deltas: DataFrame) -> DataFrame:
    """Totals while logs are being merged: logs under merge count only if the base does not hold them yet.

    The sequence of a bucket is the greatest of its contributions.
    """
    sums = []
    for bucket in ("fs", "input", "log"):
        own = F.col("bucket") == bucket
        sums += [F.sum(F.when(own, F.col(c)).otherwise(0)).alias(f"{bucket}_{c}") for c in ("total", "count")]
        sums.append(F.max(F.when(own, F.col("seq")).otherwise(0)).alias(f"{bucket}_seq"))
    g = deltas.groupBy(*NAME).agg(*sums)
    newer = ((F.col("fs_seq") != 0) & (F.col("input_seq") > F.col("fs_seq"))) | ((F.col("fs_seq") == 0) & (F.col("input_count") > 0))
    part = lambda c: F.when(F.col("fs_seq") != 0, F.col(f"fs_{c}")).otherwise(0) + F.when(newer, F.col(f"input_{c}")).otherwise(0) + F.col(f"log_{c}")
    return g.select(*NAME, part("total").alias("total"), part("count").alias("count")).where("total <> 0 or count <> 0")
