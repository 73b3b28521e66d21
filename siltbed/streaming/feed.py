"""Change logs as streams.

Sequences are no event time, so the state is a table, dealt into buckets by a
hash of the key.  A micro-batch rewrites only the buckets it touches, under its
own number; a bucket's state is its newest finished version.  A batch that is
run again reads the same older versions and overwrites its own, which makes
the merge exactly-once.  The state is found again in its folder after a
restart, and of each bucket no more than the version before the last is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest
from ..sources.scratch import folder, remove

BUCKETS = 32


def _versions(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """The finished versions of each bucket, ascending, from the names in the state's folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state/*/bucket=*")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for status in fs.globStatus(where) or ():
        path = status.getPath()
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), "_SUCCESS")):
            found.setdefault(int(path.getName().split("=")[1]), []).append(int(path.getParent().getName().split("=")[1]))
    return {b: sorted(v) for b, v in found.items()}


def _read(spark: SparkSession, root: str, held: dict[int, int], schema: object) -> DataFrame:
    paths = [f"{root}/state/version={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def newest_by_stream(changes: DataFrame, key: list[str], state: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Follows a stream of versioned rows to its present end; the newest live version of each key.

    Late rows with an older sequence change nothing, whatever batch brings them.
    """
    spark = changes.sparkSession
    root, schema = state or folder(spark), changes.schema
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets`` numbers
        known = _versions(session, root)
        before = {b: max(v for v in known[b] if v < epoch) for b in touched if any(v < epoch for v in known.get(b, ()))}
        rows = batch.unionByName(_read(session, root, before, schema))
        newest = forest.newest(rows, key, keep_deleted=True).select(*changes.columns)
        newest.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/state/version={epoch}")
        for b in before:
            for old in (v for v in known[b] if v < before[b]):
                remove(session, f"{root}/state/version={old}/bucket={b}")

    query = changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return _read(spark, root, {b: v[-1] for b, v in _versions(spark, root).items()}, schema).where("not is_delete")


def polls(rows: DataFrame, order: str, stable: list[int]) -> Iterator[DataFrame]:
    """One page for each reading of the watermark: what became stable since the last; never goes back."""
    last = -1
    for now in stable:
        now = max(now, last)
        yield rows.where((F.col(order) > last) & (F.col(order) <= now))
        last = now


def open_changes(spark: SparkSession, pattern: str, schema: str, files: int = 1) -> DataFrame:
    """A stream over the Parquet files that match a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)
