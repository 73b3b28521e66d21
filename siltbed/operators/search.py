"""Tag search: a log of toggles, of which an odd number means present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["hash", "ino", "id"]


def present(log: DataFrame) -> DataFrame:
    return log.groupBy(*KEY).agg(F.count("*").alias("__n")).where("__n % 2 = 1").drop("__n")


def candidates(log: DataFrame, tag: int, first: int, last: int, limit: int | None = None) -> DataFrame:
    """Distinct objects that may carry the tag, ascending."""
    rows = present(log.where((F.col("hash") == tag) & F.col("ino").between(first, last))).select("ino").distinct().orderBy("ino")
    return rows.limit(limit) if limit else rows


def page(log: DataFrame, tag: int, first: int, last: int, nr: int, limit: int = 1_000_000) -> DataFrame:
    """One row on a page of at most ``nr`` objects, of the ``limit`` least entries tracked: tracked, returned, is_end.

    The end is told only if the search got through all entries and as many objects are returned as entries were
    tracked, so an object met twice leaves the end untold.
    """
    rows = present(log.where((F.col("hash") == tag) & F.col("ino").between(first, last))).select("ino", "id")
    kept = rows.orderBy("ino", "id").limit(limit).agg(F.count("*").alias("tracked"), F.countDistinct("ino").alias("objects"))
    one = F.lit(1).alias("one")  # both sides are one row
    both = kept.select(one, "*").join(rows.agg(F.count("*").alias("all")).select(one, "*"), "one")
    returned = F.least("objects", F.lit(nr)).cast("long")
    return both.select("tracked", returned.alias("returned"), ((F.col("all") <= limit) & (F.col("tracked") == returned)).alias("is_end"))


def exact(found: DataFrame, xattrs: DataFrame, name_ends: str) -> DataFrame:
    """Candidates whose attributes bear the name."""
    return found.join(xattrs.where(F.col("name").endswith(name_ends)).select("ino").distinct(), "ino", "left_semi")


def compact(log: DataFrame) -> DataFrame:
    """Sorted runs without the pairs that cancel."""
    return present(log).withColumn("run", F.lit(0).cast("long"))


def plan_compaction(files: DataFrame, busy: DataFrame, fan_in: int = 4) -> DataFrame:
    """The next inputs of each size order: smallest files first, none that is busy; only full sets of ``fan_in``."""
    from pyspark.sql import Window

    order = F.floor(F.length(F.bin(F.col("blocks"))) / 2).cast("int")
    free = files.join(busy, "file", "left_anti").withColumn("order", order)
    rank = F.row_number().over(Window.partitionBy("order").orderBy("blocks", "file"))
    size = F.count("*").over(Window.partitionBy("order"))
    return free.withColumn("n", rank).withColumn("size", size).where((F.col("n") <= fan_in) & (F.col("size") >= fan_in)).drop("size")
