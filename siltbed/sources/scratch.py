"""Tables that cut lineage, in the folder the cluster names in ``spark.checkpoint.dir``.

All tables of an application lie in one folder of its own.  ``clear`` removes
it when no result that reads them is wanted any more; it also goes when the
driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This application's folder; only where no shared one is set, as in tests, in a local one."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="scratch-")
        _own[app] = f"{shared.rstrip('/')}/tables-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clear_quietly, spark, app)
    return _own[app]


def folder(spark: SparkSession) -> str:
    """A new path in the application's folder."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet and read back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Removes a written table that nothing will read again."""
    remove(df.sparkSession, df._scratch_path)


def clear(spark: SparkSession) -> None:
    """Removes all of the application's tables; results not yet computed from them are lost."""
    if path := _own.pop(spark.sparkContext.applicationId, None):
        remove(spark, path)


def _clear_quietly(spark: SparkSession, app: str) -> None:
    if path := _own.pop(app, None):
        try:
            remove(spark, path)
        except Exception:  # the gateway is gone: the folder is the cluster's to clean
            pass
