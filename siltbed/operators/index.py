"""Sequence index: change feed, watermark, attribute index, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def at_least(columns: list[str], bound: tuple) -> Column:
    """(c1, c2, ...) >= bound, in the order of the columns."""
    return F.struct(*columns) >= F.struct(*[F.lit(b).alias(c) for c, b in zip(columns, bound, strict=True)])


def at_most(columns: list[str], bound: tuple) -> Column:
    return F.struct(*columns) <= F.struct(*[F.lit(b).alias(c) for c, b in zip(columns, bound, strict=True)])


def latest_logs(open_trans: DataFrame) -> DataFrame:
    """The log of greatest number for each mount."""
    return open_trans.groupBy("rid").agg(F.max_by(F.struct("nr", "get_trans_seq", "commit_trans_seq", "mounted"), "nr").alias("t")).select("rid", "t.*")


def stable_seq(open_trans: DataFrame, last_seq: Column | int) -> DataFrame:
    """One row, stable_seq: below every open transaction of a mounted client."""
    last = F.lit(last_seq) if isinstance(last_seq, int) else last_seq
    open_ = latest_logs(open_trans).where("get_trans_seq > commit_trans_seq and mounted").agg(F.min("get_trans_seq").alias("open_seq"))
    return open_.select(F.least(last, F.coalesce(F.col("open_seq") - 1, last)).cast("long").alias("stable_seq"))


def walk(seq_index: DataFrame, index: str, first: tuple, last: tuple, limit: int | None = None, watermark: DataFrame | None = None) -> DataFrame:
    """major, minor, ino between first and last, both included, sorted; never above the watermark.

    Reversed bounds give no rows; an unknown index is an error.
    """
    if index not in ("meta_seq", "data_seq"):
        raise ValueError(f"unknown index {index}")
    key = ["major", "minor", "ino"]
    rows = seq_index.where(F.col("index") == index).where(F.col("major").between(first[0], last[0])).where(at_least(key, first) & at_most(key, last))
    if watermark is not None:
        rows = rows.join(F.broadcast(watermark), F.col("major") <= F.col("stable_seq"))
    rows = rows.select(*key).orderBy(*key)
    return rows.limit(limit) if limit else rows


def read_index(xattr_index: DataFrame, first: tuple, last: tuple, limit: int | None = None) -> DataFrame:
    """Distinct (major, minor, ino) in a range; reversed bounds are an error."""
    if first > last:
        raise ValueError("the first position is after the last")
    key = ["major", "minor", "ino"]
    rows = xattr_index.where(F.col("major").between(first[0], last[0])).where(at_least(key, first) & at_most(key, last)).select(*key).distinct().orderBy(*key)
    return rows.limit(limit) if limit else rows


def group_of(ino: Column) -> Column:
    """Objects are numbered in groups of 1024."""
    return F.call_function("div", ino, F.lit(1024))


def allocated(inodes: DataFrame, start: int) -> DataFrame:
    return inodes.where(F.col("ino").between(start, start | 1023)).select("ino").distinct().orderBy("ino")


def with_last_flag(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """is_last: no entry follows."""
    return rows.withColumn("is_last", F.lead(order[-1]).over(Window.partitionBy(*partition).orderBy(*order)).isNull())


def entry_at(rows: DataFrame, partition: list[str], order: list[str], position: int) -> DataFrame:
    """The entry at a position, from 0, of each partition."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("__n") == position + 1).drop("__n")


def pages(rows: DataFrame, key: list[str], size: int, n: int) -> DataFrame:
    """The first ``n`` pages as a client reads them: each resumes after the last key of the one before.

    Only a page's last key comes to the driver.
    """
    out, left = None, rows.select(*key)
    for i in range(n):
        page = left.orderBy(*key).limit(size)
        out = page.withColumn("page", F.lit(i)) if out is None else out.unionByName(page.withColumn("page", F.lit(i)))
        last = page.agg(F.max(F.struct(*key)).alias("last")).first()["last"]
        if last is None:
            break
        left = left.where(F.struct(*key) > F.struct(*[F.lit(last[k]).alias(k) for k in key]))
    return out


def all_pages(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """Every row with its page, in the order of a unique key: a rank within a range of keys and the offset of the range.

    The ranges are written, as Spark may sample other bounds when it computes them again. The only
    window over all is over one count for each range.
    """
    dealt = written(rows.select(*key).repartitionByRange(*key).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__range").orderBy(*key)))
    at = F.col("__before") + F.col("__rank") - 1
    return ranked.join(F.broadcast(offsets), "__range").select(*key, F.call_function("div", at, F.lit(size)).alias("page"))


def bitmap(rows: DataFrame, by: list[str], bit: Column, width: int = 32) -> DataFrame:
    """Numbers as words of ``width`` bits: by, word, bits, n_set."""
    word = F.call_function("div", bit, F.lit(width))
    mask = F.expr(f"shiftleft(1L, cast(__bit % {width} as int))")
    found = rows.withColumn("__bit", bit).groupBy(*by, word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    return found.withColumn("n_set", F.bit_count("bits").cast("long"))


def finalize(manifest: DataFrame) -> DataFrame:
    """Whether a log is finalized: its tree is higher than 2, its allocator is low, or it is asked for."""
    return manifest.withColumn("finalize", (F.col("height") > 2) | F.col("low") | F.col("forced"))


def next_finalized(log: DataFrame, merge_seq: int, first: int, last: int) -> DataFrame:
    """The least key in [first, last] of logs finalized before ``merge_seq``; no row if there is none."""
    return log.where((F.col("finalize_seq") < merge_seq) & F.col("key").between(first, last)).agg(F.min("key").alias("key")).where("key is not null")
