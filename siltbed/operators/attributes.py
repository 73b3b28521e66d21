"""Object attributes chosen and changed by mask.

Bits of a mask are fixed values of the interface.  A change is checked whole
before any of it is made: an invalid or retained one changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attribute bits of a mask, in the order of the interface.
MASK = {"meta_seq": 1, "data_seq": 2, "data_version": 4, "online_blocks": 8, "offline_blocks": 16, "ctime": 32, "crtime": 64, "size": 128, "retention": 256, "project": 512}
#: A change's flag for offline extents up to its size, the retention bit of its bits, an object's own flag.
SIZE_OFFLINE, RETAIN, RETAINED = 1, 1, 2
BLOCK = 4096


def has(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(MASK[name]) != 0


def columns_of(attributes: DataFrame, mask: int) -> DataFrame:
    """ino and the columns of a mask; the scan reads no others."""
    return attributes.select("ino", *[c for c, bit in MASK.items() if mask & bit])


def chosen(attributes: DataFrame, requests: DataFrame) -> DataFrame:
    """ino and every attribute, null where the request's (ino, mask) does not ask for it; unknown bits are refused."""
    known = reduce(lambda a, b: a | b, MASK.values())
    rows = requests.where(F.col("mask").bitwiseAND(~known) == 0).join(attributes, "ino")
    return rows.select("ino", *[F.when(has(F.col("mask"), c), F.col(c)).alias(c) for c in MASK if c in attributes.columns])


def is_valid() -> Column:
    """The rules of a change (mask, change_flags, new_version, new_size) against its object (is_dir, data_version)."""
    mask, regular = F.col("mask"), ~F.col("is_dir")
    version, size = has(mask, "data_version"), has(mask, "size")
    return (
        ~(version & (F.col("new_version") == 0))
        & ~((size | version) & (~regular | (F.col("data_version") != 0)))
        & ~(size & (F.col("new_size") > 0) & (~version | (F.col("new_version") == 0)))
        & ~((F.col("change_flags").bitwiseAND(SIZE_OFFLINE) != 0) & (~size | (F.col("new_size") == 0)))
        & ~(has(mask, "retention") & ~regular)
    )


def status() -> Column:
    """'none' without a mask, 'invalid', 'retained' unless the change itself ends the retention, else 'ok'."""
    mask = F.col("mask")
    ends = has(mask, "retention") & (F.col("bits").bitwiseAND(RETAIN) == 0)
    held = (F.col("flags").bitwiseAND(RETAINED) != 0) & ~ends
    return F.when(mask == 0, "none").when(~is_valid(), "invalid").when(held, "retained").otherwise("ok")


def change(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """ino, status, data_version, size, flags, proj and the offline blocks made, after one change at most for each object."""
    rows = objects.join(requests, "ino", "left").withColumn("mask", F.coalesce("mask", F.lit(0))).withColumn("status", status())
    ok = F.col("status") == "ok"
    put = lambda name, new, old: F.when(ok & has(F.col("mask"), name), new).otherwise(F.col(old)).cast("long").alias(old)
    kept = F.col("flags").bitwiseAND(~RETAINED)
    flags = kept.bitwiseOR(F.when(F.col("bits").bitwiseAND(RETAIN) != 0, RETAINED).otherwise(0))
    made = F.when(ok & (F.col("change_flags").bitwiseAND(SIZE_OFFLINE) != 0), F.ceil(F.col("new_size") / BLOCK)).otherwise(0)
    return rows.select("ino", "status", put("data_version", F.col("new_version"), "data_version"), put("size", F.col("new_size"), "size"), put("retention", flags, "flags"), put("project", F.col("new_proj"), "proj"), made.cast("long").alias("offline_made"))
