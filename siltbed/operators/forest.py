"""A base and many change logs: newest wins, tombstones, merges and DML as appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def newest(log: DataFrame, key: list[str], keep_deleted: bool = False) -> DataFrame:
    """The newest version of each key; of equal sequences the base's; deleted keys vanish.

    One aggregation with partial sums: a key with very many versions does not gather them.
    """
    rest = [c for c in log.columns if c not in key]
    rank = F.struct("seq", (F.col("source") == "base").alias("base"))
    rows = log.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("v")).select(*key, "v.*")
    return rows if keep_deleted else rows.where("not is_delete")


def snapshot(log: DataFrame, key: list[str], seq: int) -> DataFrame:
    """The newest versions as of a sequence."""
    return newest(log.where(F.col("seq") <= seq), key)


def merge_into_base(log: DataFrame, key: list[str]) -> DataFrame:
    """What a merge does to each key of the base: insert, update, delete, keep or nothing."""
    base = newest(log.where("source = 'base'"), key)
    change = newest(log.where("source <> 'base'"), key, keep_deleted=True)
    b = base.select(*key, F.col("seq").alias("base_seq"), F.col("val").alias("base_val"))
    c = change.select(*key, F.col("seq").alias("log_seq"), F.col("val").alias("log_val"), F.col("is_delete").alias("log_delete"))
    wins = F.col("base_seq").isNull() | (F.col("log_seq") > F.col("base_seq"))
    action = F.when(F.col("log_seq").isNull() | ~wins, "keep").when(F.col("log_delete"), F.when(F.col("base_seq").isNull(), "none").otherwise("delete")).otherwise(F.when(F.col("base_seq").isNull(), "insert").otherwise("update"))
    return b.join(c, key, "full_outer").select(*key, action.alias("action"), F.when(action.isin("insert", "update"), F.col("log_val")).when(action == "keep", F.col("base_val")).alias("val"))


def create(existing: DataFrame, new: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """New rows with status 'ok' or 'exists'."""
    known = existing.select(*key).distinct().withColumn("__known", F.lit(True))
    status = F.lit("ok") if force else F.when(F.col("__known"), "exists").otherwise("ok")
    return new.join(known, key, "left").withColumn("status", status).drop("__known")


def update(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows with status 'ok' or 'missing'."""
    known = existing.select(*key).distinct().withColumn("__known", F.lit(True))
    return new.join(known, key, "left").withColumn("status", F.when(F.col("__known"), "ok").otherwise("missing")).drop("__known")


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All of new, and of existing what new does not replace."""
    return existing.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def next_key(rows: DataFrame, key: str, at: Column | int, before: bool = False) -> DataFrame:
    """The least key not below ``at``, or the greatest not above it."""
    return rows.where(F.col(key) <= at if before else F.col(key) >= at).agg((F.max if before else F.min)(key).alias(key)).where(F.col(key).isNotNull())


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to insert into and delete from a sequence index: only where the sequence changed."""
    both = old.select("ino", F.col("major").alias("old_major")).join(new.select("ino", F.col("major").alias("new_major")), "ino", "full_outer").where(~F.col("old_major").eqNullSafe(F.col("new_major")))
    pair = F.array(F.struct(F.lit("delete").alias("op"), F.col("old_major").alias("major")), F.struct(F.lit("insert").alias("op"), F.col("new_major").alias("major")))
    return both.select("ino", F.explode(pair).alias("p")).select("ino", "p.op", "p.major").where("major is not null")


def sorted_runs(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows written as sorted files of disjoint key ranges, which later range filters skip by their statistics."""
    return written(rows.repartitionByRange(*key).sortWithinPartitions(*key))


def merged(runs: list[DataFrame], key: list[str]) -> DataFrame:
    """Sorted runs in one order, range by range: no task merges more than its range of keys."""
    return reduce(DataFrame.unionByName, runs).orderBy(*key)


def presence(runs: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Merge of any number of runs: every key and, by the run's name, whether that run holds it.

    One aggregation with partial sums; no run is joined to another.
    """
    marked = [rows.select(*key, *[F.lit(n == name).alias(n) for n in runs]) for name, rows in runs.items()]
    return reduce(DataFrame.unionByName, marked).groupBy(*key).agg(*[F.bool_or(n).alias(n) for n in runs])


def merge_window(items: DataFrame, key: list[str], deltas: DataFrame, names: list[str]) -> DataFrame:
    """Items and deltas of all logs in one window, one row for each key: kind, a, b, c, seq, is_delete, val, total, count."""
    version = items.groupBy(*key).agg(F.max_by(F.struct("seq", "is_delete", "val"), "seq").alias("v")).select(F.lit("item").alias("kind"), F.col(key[0]).alias(names[0]), "v.*")
    sums = deltas.groupBy(*names).agg(F.max("seq").alias("seq"), F.sum("total").alias("total"), F.sum("count").alias("count")).where("total <> 0 or count <> 0")
    return version.unionByName(sums.select(F.lit("delta").alias("kind"), "*", F.lit(False).alias("is_delete")), allowMissingColumns=True)


def options(changes: DataFrame) -> DataFrame:
    """Volume options (bit, seq, op, value): the last set or clear of each bit decides; cleared ones are gone."""
    return changes.groupBy("bit").agg(F.max_by(F.struct("op", "value"), "seq").alias("v")).where("v.op = 'set'").select("bit", "v.value")
