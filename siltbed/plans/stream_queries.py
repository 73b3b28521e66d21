"""Streaming forms of the change feed and of newest-wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ..sources.tables import Tables
from ..streaming import feed
from .catalog import query


@query("t06_stream_newest", "WITH n AS (SELECT * FROM item_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, source) = 1) SELECT key, seq, is_delete, val, source FROM n WHERE NOT is_delete", "item_log")
def stream_newest(t: Tables) -> DataFrame:
    """The log as a stream of several batches that cut across keys and sequences, so later ones bring older versions too."""
    log = t.item_log()
    files = folder(t.spark)
    log.repartition(3, F.col("seq") % 7).write.parquet(files)
    return feed.newest_by_stream(t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(files), ["key"])


@query("t03_stable_polls", "SELECT CASE WHEN major <= 2000 THEN 0 WHEN major <= 9000 THEN 1 ELSE 2 END AS poll, count(*) AS n, min(major) AS first, max(major) AS last FROM seq_index WHERE index = 'meta_seq' GROUP BY 1", "seq_index")
def stable_polls(t: Tables) -> DataFrame:
    """A watermark that falls back does not repeat rows."""
    rows = t.seq_index().where("index = 'meta_seq'")
    pages = [p.select(F.lit(i if i < 2 else i - 1).alias("poll"), "major") for i, p in enumerate(feed.polls(rows, "major", [2000, 9000, 5000, 10**9])) if i != 2]
    return reduce(DataFrame.unionByName, pages).groupBy("poll").agg(F.count("*").alias("n"), F.min("major").alias("first"), F.max("major").alias("last"))
