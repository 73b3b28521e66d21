"""The name tree: links, paths, ancestors.

A directory has one link, a file may have many.  Everything is read from the
chains of directories between an object and the root: chains double in length
with every round, so a tree of depth d takes about log2(d) joins over one row
for each directory, each written before the next.

An object without a way to the root has no chain and no path.  A directory
that lies below itself, or a link to the root, is an error at any depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def _links(dirents: DataFrame) -> DataFrame:
    """ino, dir_ino, pos, name; position and name may be left out."""
    known = dirents.columns
    pos = F.col("pos") if "pos" in known else F.lit(0)
    name = F.col("name") if "name" in known else F.lit(None).cast("string")
    return dirents.select("ino", "dir_ino", pos.cast("long").alias("pos"), name.alias("name"))


def chains(dirents: DataFrame, root: int = 1) -> DataFrame:
    """(ino, ids, names) of every directory with entries: what leads to it from the root, itself last."""
    links = _links(dirents)
    parents = links.select(F.col("dir_ino").alias("ino")).distinct()
    first = links.join(parents, "ino", "left_semi").groupBy("ino").agg(F.min(F.struct("dir_ino", "pos", "name")).alias("l"))
    now = written(first.select("ino", F.col("l.dir_ino").alias("up"), F.array("ino").alias("ids"), F.array("l.name").alias("names")))
    rounds, done = now.count().bit_length() + 1, []
    if not links.where(F.col("ino") == root).isEmpty():
        raise ValueError("directories nest in a cycle")
    while True:
        done.append(now.where(F.col("up") == root))
        ahead = now.where(F.col("up") != root)
        if ahead.isEmpty():
            return reduce(DataFrame.unionByName, done).select("ino", "ids", "names")
        if not rounds:
            raise ValueError("directories nest in a cycle")
        above = reduce(DataFrame.unionByName, [*done, ahead]).select(F.col("ino").alias("up"), F.col("up").alias("next"), F.col("ids").alias("more"), F.col("names").alias("more_names"))
        now = written(ahead.join(above, "up").select("ino", F.col("next").alias("up"), F.concat("more", "ids").alias("ids"), F.concat("more_names", "names").alias("names")))
        rounds -= 1


def lineage(dirents: DataFrame, root: int = 1, known: DataFrame | None = None) -> DataFrame:
    """Every link (ino, dir_ino, pos, name) with the directories above it, the root first: ids and names."""
    links = _links(dirents)
    above = (chains(dirents, root) if known is None else known).withColumnRenamed("ino", "dir_ino").select("dir_ino", F.concat(F.array(F.lit(root).cast("long")), F.col("ids")).alias("ids"), "names")
    top = links.where(F.col("dir_ino") == root).select("*", F.array(F.lit(root).cast("long")).alias("ids"), F.array().cast("array<string>").alias("names"))
    return links.where(F.col("dir_ino") != root).join(above, "dir_ino").select("ino", "dir_ino", "pos", "name", "ids", "names").unionByName(top)


def ancestors(dirents: DataFrame, root: int = 1) -> DataFrame:
    """(ino, ancestor, depth): every object with all directories above it by any of its links, itself at depth 0."""
    up = lineage(dirents, root).select("ino", F.posexplode(F.reverse("ids")).alias("at", "ancestor"))
    return up.select("ino", "ancestor", (F.col("at") + 1).cast("long").alias("depth")).unionByName(dirents.select("ino", F.col("ino").alias("ancestor"), F.lit(0).cast("long").alias("depth"))).distinct()


def _path(names: Column, name: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.concat(names, F.array(name)), "/"))


def paths(dirents: DataFrame, root: int = 1) -> DataFrame:
    """(ino, dir_ino, pos, path): one path for each link."""
    return lineage(dirents, root).select("ino", "dir_ino", "pos", _path(F.col("names"), F.col("name")).alias("path"))


def next_path(dirents: DataFrame, cursors: DataFrame, root: int = 1) -> DataFrame:
    """For each cursor (ino, dir_ino, pos) the object's first link at it or behind it, with its path; no row if none follows."""
    at = cursors.select("ino", F.struct("dir_ino", F.col("pos").cast("long").alias("pos")).alias("cursor"))
    ahead = at.join(_links(dirents), "ino").where(F.struct("dir_ino", "pos") >= F.col("cursor"))
    first = ahead.groupBy("ino", "cursor").agg(F.min(F.struct("dir_ino", "pos")).alias("l")).select("ino", "cursor", "l.*")
    return first.join(paths(dirents, root), ["ino", "dir_ino", "pos"]).select("ino", F.col("cursor.dir_ino").alias("from_dir"), F.col("cursor.pos").alias("from_pos"), "dir_ino", "pos", "path")


def _above(dirents: DataFrame, known: DataFrame, root: int) -> DataFrame:
    """(ino, ids): objects themselves and all directories above them by any link."""
    up = lineage(dirents, root, known).select("ino", F.concat("ids", F.array("ino")).alias("ids"))
    return up.groupBy("ino").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))


def rename_allowed(dirents: DataFrame, moves: DataFrame, root: int = 1) -> DataFrame:
    """moves (ino, to_dir) with allowed: a directory must not move below itself."""
    targets = moves.select(F.col("to_dir").alias("ino")).distinct()
    above = _above(dirents.join(targets, "ino", "left_semi"), chains(dirents, root), root).withColumnRenamed("ino", "to_dir")
    below = F.coalesce(F.array_contains("ids", F.col("ino")), F.col("ino") == F.col("to_dir"))
    return moves.join(above, "to_dir", "left").select("ino", "to_dir", (~below).alias("allowed"))


def common_ancestors(dirents: DataFrame, pairs: DataFrame, root: int = 1) -> DataFrame:
    """pairs (x, y) with the nearest object above both, themselves included; objects of one link."""
    asked = pairs.select(F.col("x").alias("ino")).unionByName(pairs.select(F.col("y").alias("ino"))).distinct()
    above = written(_above(dirents.join(asked, "ino", "left_semi"), chains(dirents, root), root))
    both = pairs.join(above.select(F.col("ino").alias("x"), F.col("ids").alias("a")), "x").join(above.select(F.col("ino").alias("y"), F.col("ids").alias("b")), "y")
    return both.select("x", "y", F.element_at(F.array_intersect("a", "b"), -1).alias("ancestor"))


def mode_type(mode: Column) -> Column:
    """Entry type by the type bits of a mode; fixed values of POSIX."""
    kinds = {0o010000: "fifo", 0o020000: "char", 0o040000: "dir", 0o060000: "block", 0o100000: "file", 0o120000: "symlink", 0o140000: "socket"}
    bits = mode.bitwiseAND(0o170000)
    out = F.lit("unknown")
    for value, name in kinds.items():
        out = F.when(bits == value, name).otherwise(out)
    return out
