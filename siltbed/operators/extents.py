"""Interval algebra over (ino, start, len, map, flags); map 0 is unmapped, flag 1 offline, flag 2 unwritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

OFFLINE, UNWRITTEN = 1, 2
COLUMNS = ["ino", "start", "len", "map", "flags"]


def _as_it_is(df: DataFrame, *keys: str) -> DataFrame:
    return df


def shifted(map_: Column, by: Column) -> Column:
    """A mapping moved along with its extent; unmapped stays unmapped."""
    return F.when(map_ == 0, 0).otherwise(map_ + by).cast("long")


def coalesce(extents: DataFrame) -> DataFrame:
    """Neighbours that touch, with equal flags and mappings that touch too (or none), become one."""
    w = Window.partitionBy("ino").orderBy("start")
    end, map_end = F.lag(F.col("start") + F.col("len")).over(w), F.lag(F.col("map") + F.col("len")).over(w)
    unmapped = (F.lag("map").over(w) == 0) & (F.col("map") == 0)
    joins = (end == F.col("start")) & (unmapped | ((F.lag("map").over(w) != 0) & (F.col("map") != 0) & (map_end == F.col("map")))) & (F.lag("flags").over(w) == F.col("flags"))
    island = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w)
    rows = extents.withColumn("__island", island).groupBy("ino", "__island").agg(F.min("start").alias("start"), F.sum("len").alias("len"), F.min_by("map", "start").alias("map"), F.first("flags").alias("flags"))
    return rows.select(*COLUMNS)


def clip(extents: DataFrame, first: Column, end: Column) -> DataFrame:
    """The parts of extents inside [first, end)."""
    e_end = F.col("start") + F.col("len")
    start = F.greatest("start", first)
    inside = extents.where((F.col("start") < end) & (e_end > first))
    return inside.select("ino", start.alias("start"), (F.least(e_end, end) - start).alias("len"), shifted(F.col("map"), start - F.col("start")).alias("map"), "flags")


def _pieces(extents: DataFrame, ranges: DataFrame, *keep: str) -> DataFrame:
    """Each extent split by its object's range (first, end): column inside tells which pieces it covers; keep: columns of the range."""
    rows = extents.join(ranges, "ino", "left")
    e_end = F.col("start") + F.col("len")
    a, b = F.greatest("start", F.least("first", e_end)), F.least(e_end, F.greatest("end", F.col("start")))
    hit = F.col("first").isNotNull() & (F.col("start") < F.col("end")) & (e_end > F.col("first"))
    piece = lambda lo, hi, inside: F.struct(lo.alias("start"), (hi - lo).alias("len"), shifted(F.col("map"), lo - F.col("start")).alias("map"), F.lit(inside).alias("inside"))
    parts = F.when(hit, F.array(piece(F.col("start"), a, False), piece(a, b, True), piece(b, e_end, False))).otherwise(F.array(piece(F.col("start"), e_end, False)))
    return rows.select("ino", "flags", *keep, F.explode(parts).alias("p")).where("p.len > 0").select("ino", "p.start", "p.len", "p.map", "flags", "p.inside", *keep)


def remove(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    return _pieces(extents, ranges).where("not inside").select(*COLUMNS)


def release(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks in the range go offline: unmapped and flagged; then neighbours merge."""
    p = _pieces(extents, ranges)
    return coalesce(p.select("ino", "start", "len", F.when(F.col("inside"), 0).otherwise(F.col("map")).cast("long").alias("map"), F.when(F.col("inside"), OFFLINE).otherwise(F.col("flags")).cast("long").alias("flags")))


def stage(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Offline blocks in the range (first, end, to_map) come online at the mapping that begins at to_map for first."""
    p = _pieces(extents, ranges, "first", "to_map")
    change = F.col("inside") & (F.col("flags") == OFFLINE)
    return coalesce(p.select("ino", "start", "len", F.when(change, F.col("to_map") + F.col("start") - F.col("first")).otherwise(F.col("map")).cast("long").alias("map"), F.when(change, 0).otherwise(F.col("flags")).cast("long").alias("flags")))


def punch_offline(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Offline blocks in the range become holes; an object with a mapped one there is refused and unchanged."""
    p = _pieces(extents, ranges)
    refused = p.where("inside and map <> 0").select("ino").distinct()
    ok = ranges.join(refused, "ino", "left_anti")
    return coalesce(_pieces(extents, ok).where("not (inside and flags = 1)").select(*COLUMNS))


def set_range(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sets map and flags on a range (first, end, set_map, set_flags) that lies inside one extent or in a gap.

    map and flags both 0 delete; objects whose range overlaps an extent without lying in it are unchanged.
    """
    e_end = F.col("start") + F.col("len")
    over = extents.join(ranges, "ino").where((F.col("start") < F.col("end")) & (e_end > F.col("first")))
    bad = over.where((F.col("start") > F.col("first")) | (e_end < F.col("end"))).select("ino").distinct()
    ok = ranges.join(bad, "ino", "left_anti")
    new = ok.where("set_map <> 0 or set_flags <> 0").select("ino", F.col("first").alias("start"), (F.col("end") - F.col("first")).alias("len"), F.col("set_map").alias("map"), F.col("set_flags").alias("flags"))
    return coalesce(remove(extents, ok.select("ino", "first", "end")).unionByName(new))


def insert_conflicts(extents: DataFrame, new: DataFrame) -> DataFrame:
    """New extents that overlap one that is there."""
    n = new.select("ino", F.col("start").alias("n_start"), F.col("len").alias("n_len"))
    return n.join(extents, "ino").where("start < n_start + n_len and n_start < start + len").select("ino", F.col("n_start").alias("start"), F.col("n_len").alias("len")).distinct()


def move(extents: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (ino, to_ino, first, end, to_first): the clipped pieces under their new object and place."""
    p = extents.join(moves, "ino")
    e_end = F.col("start") + F.col("len")
    lo, hi = F.greatest("start", "first"), F.least(e_end, F.col("end"))
    p = p.where((F.col("start") < F.col("end")) & (e_end > F.col("first")))
    return p.select(F.col("to_ino").alias("ino"), (lo - F.col("first") + F.col("to_first")).alias("start"), (hi - lo).alias("len"), shifted(F.col("map"), lo - F.col("start")).alias("map"), "flags")


def state(map_: Column, flags: Column) -> Column:
    return F.when(flags.bitwiseAND(OFFLINE) != 0, "OFFLINE").when(flags.bitwiseAND(UNWRITTEN) != 0, "UNWRITTEN").when(map_ != 0, "MAPPED").otherwise("HOLE")


def on_off(extents: DataFrame) -> DataFrame:
    """Blocks online (mapped and written) and offline for each object."""
    online = (F.col("map") != 0) & (F.col("flags").bitwiseAND(UNWRITTEN) == 0)
    offline = ~online & (F.col("flags").bitwiseAND(OFFLINE) != 0)
    return extents.groupBy("ino").agg(F.sum(F.when(online, F.col("len")).otherwise(0)).alias("online"), F.sum(F.when(offline, F.col("len")).otherwise(0)).alias("offline"))


def order_bucket(length: Column) -> Column:
    """floor(log8(length)), from the exact number of bits."""
    return F.call_function("div", F.length(F.bin(length)) - 1, F.lit(3)).cast("long")


def take_until(extents: DataFrame, order: list[str], wanted: int) -> DataFrame:
    """The first extents of each object until their lengths reach ``wanted``; the last is cut."""
    before = F.coalesce(F.sum("len").over(Window.partitionBy("ino").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return extents.withColumn("__before", before).where(F.col("__before") < wanted).withColumn("len", F.least("len", wanted - F.col("__before"))).drop("__before")


def next_overlapping(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each range (first, end) the first extent that reaches into it."""
    rows = ranges.join(extents, "ino").where("start < end and start + len > first")
    return rows.groupBy("ino", "first", "end").agg(F.min_by(F.struct("start", "len"), "start").alias("e")).select("ino", "first", "end", "e.start", "e.len")


def covered(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Whether disjoint extents cover each range (first, end) wholly, and whether one of them is unwritten."""
    rows = ranges.join(extents, "ino", "left")
    # greatest and least pass over nulls, so a range without extents is told apart first.
    inside = F.when(F.col("start").isNull(), 0).otherwise(F.greatest(F.least(F.col("start") + F.col("len"), F.col("end")) - F.greatest("start", "first"), F.lit(0)))
    dirty = (inside > 0) & (F.col("flags").bitwiseAND(UNWRITTEN) != 0)
    found = rows.groupBy("ino", "first", "end").agg(F.sum(inside).alias("n"), F.max(F.coalesce(dirty, F.lit(False))).alias("dirty"))
    return found.select("ino", (F.col("n") == F.col("end") - F.col("first")).alias("covered"), "dirty")


def newest_ranges(ranges: DataFrame) -> DataFrame:
    """Of overlapping ranges (ino, first, end, read_seq) the newest keeps each block; older ones are trimmed or dropped."""
    cuts = ranges.select("ino", F.explode(F.array("first", "end")).alias("start")).distinct()
    parts = cuts.withColumn("stop", F.lead("start").over(Window.partitionBy("ino").orderBy("start"))).where("stop is not null")
    owned = parts.join(ranges, "ino").where("first <= start and end >= stop").groupBy("ino", "start", "stop").agg(F.max("read_seq").alias("read_seq"))
    w = Window.partitionBy("ino").orderBy("start")
    same = (F.lag("stop").over(w) == F.col("start")) & (F.lag("read_seq").over(w) == F.col("read_seq"))
    rows = owned.withColumn("__run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    return rows.groupBy("ino", "__run").agg(F.min("start").alias("first"), F.max("stop").alias("end"), F.first("read_seq").alias("read_seq")).drop("__run")


def move_blocks(extents: DataFrame, moves: DataFrame, deal: Callable[..., DataFrame] = _as_it_is) -> DataFrame:
    """All extents after the moves (ino, to_ino, first, end, to_first); a target that overlaps an extent refuses its move.

    ``deal`` says how rows are dealt by a key where a task must hold them.
    """
    into = moves.select(F.col("to_ino").alias("ino"), F.col("ino").alias("from_ino"), F.col("to_first").alias("lo"), (F.col("to_first") + F.col("end") - F.col("first")).alias("hi"))
    full = deal(deal(into, "ino").join(extents, "ino").where("start < hi and start + len > lo").select(F.col("from_ino").alias("ino")), "ino").distinct()
    ok = moves.join(full, "ino", "left_anti")
    return coalesce(deal(remove(extents, ok.select("ino", "first", "end")).unionByName(move(extents, ok)), "ino"))


def zones_of(extents: DataFrame, size: int = 16) -> DataFrame:
    """A row for each zone of ``size`` blocks that an extent touches."""
    return extents.withColumn("zone", F.explode(F.sequence(F.call_function("div", F.col("start"), F.lit(size)), F.call_function("div", F.col("start") + F.col("len") - 1, F.lit(size)))))


# ---- changes with the checks of their interface, in bytes; one for each object at most

BLOCK = 4096


def _up(size: Column) -> Column:
    """Blocks that hold so many bytes."""
    return F.call_function("div", size + (BLOCK - 1), F.lit(BLOCK))


def subtract(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """The parts of extents outside any number of disjoint ranges (ino, first, end)."""
    e_end = F.col("start") + F.col("len")
    r = ranges.select("ino", "first", "end")
    rows = extents.join(r, [extents["ino"] == r["ino"], r["first"] < e_end, r["end"] > F.col("start")], "left").select(extents["ino"], "start", "len", "map", "flags", "first", "end")
    w = Window.partitionBy("ino", "start").orderBy("first")
    rows = rows.select("*", F.greatest("start", F.coalesce(F.lag("end").over(w), F.col("start"))).alias("lo"), F.lead("first").over(w).isNull().alias("last"))
    gap = F.struct("lo", F.least(e_end, F.coalesce("first", e_end)).alias("hi"))
    tail = F.struct(F.coalesce("end", e_end).alias("lo"), e_end.alias("hi"))
    parts = rows.select("ino", "start", "map", "flags", F.explode(F.when(F.col("last"), F.array(gap, tail)).otherwise(F.array(gap))).alias("p")).where("p.lo < p.hi")
    return parts.select("ino", F.col("p.lo").alias("start"), (F.col("p.hi") - F.col("p.lo")).alias("len"), shifted(F.col("map"), F.col("p.lo") - F.col("start")).alias("map"), "flags")


def release_checked(extents: DataFrame, requests: DataFrame, inodes: DataFrame) -> DataFrame:
    """Releases (ino, offset, length, version) of regular files under their data version, in whole blocks.

    An object that is left without online blocks also loses what lies behind its size.
    """
    rows = requests.join(inodes.select("ino", "size", "data_version", "is_dir"), "ino")
    ok = rows.where((F.col("length") > 0) & (F.col("offset") % BLOCK == 0) & (F.col("length") % BLOCK == 0) & ~F.col("is_dir") & (F.col("version") == F.col("data_version")))
    span = F.call_function("div", F.col("offset"), F.lit(BLOCK)).alias("first"), F.call_function("div", F.col("offset") + F.col("length"), F.lit(BLOCK)).alias("end")
    after = release(extents, ok.select("ino", *span))
    empty = on_off(after).where("online = 0").select("ino")
    cut = ok.where("size > 0").join(empty, "ino", "left_semi").select("ino", _up(F.col("size")).alias("first"), F.lit(2**62).alias("end"))
    return remove(after, cut)


def stage_status(requests: DataFrame, inodes: DataFrame) -> DataFrame:
    """Stages (ino, offset, length, version) with what they ask for checked: 'none', 'invalid', 'stale' or 'ok'."""
    end = F.col("offset") + F.col("length")
    wrong = (F.col("length") < 0) | (F.col("offset") % BLOCK != 0)
    outside = F.col("is_dir") | (end > F.col("size")) | ((end % BLOCK != 0) & (end != F.col("size")))
    rows = requests.join(inodes.select("ino", "size", "data_version", "is_dir"), "ino")
    return rows.withColumn("status", F.when(wrong, "invalid").when(F.col("length") == 0, "none").when(outside, "invalid").when(F.col("version") != F.col("data_version"), "stale").otherwise("ok"))


def stage_checked(extents: DataFrame, requests: DataFrame, inodes: DataFrame) -> DataFrame:
    """Extents after the stages that are right; their blocks lie at ``to_map`` and behind it."""
    ok = stage_status(requests, inodes).where("status = 'ok'")
    return stage(extents, ok.select("ino", F.call_function("div", F.col("offset"), F.lit(BLOCK)).alias("first"), _up(F.col("offset") + F.col("length")).alias("end"), "to_map"))


def move_status(extents: DataFrame, requests: DataFrame, inodes: DataFrame, deal: Callable[..., DataFrame] = _as_it_is) -> DataFrame:
    """Moves (ino, to_ino, from_off, length, to_off, is_stage, version) with their blocks, clipped to the size, and a status.

    A plain move needs free blocks in the target, a staging one blocks that lie in one offline extent; a move
    is made whole or not at all.  ``deal`` says how rows are dealt by a key where a task must hold them; extents are read
    three times, so they should be written.
    """
    source = inodes.select("ino", F.col("size").alias("from_size"), F.col("is_dir").alias("from_dir"))
    target = inodes.select(F.col("ino").alias("to_ino"), F.col("data_version").alias("to_version"), F.col("is_dir").alias("to_dir"), (F.col("flags").bitwiseAND(2) != 0).alias("to_held"))
    off = on_off(extents).where("offline > 0")
    # First all that is found by the source, then all by the target.
    rows = deal(requests, "ino").join(source, "ino").join(off.select("ino", F.col("offline").alias("from_off_blocks")), "ino", "left")
    rows = deal(rows, "to_ino").join(target, "to_ino").join(off.select(F.col("ino").alias("to_ino"), F.col("offline").alias("to_off_blocks")), "to_ino", "left")
    inside = F.least("length", F.col("from_size") - F.col("from_off"))
    unaligned = (F.col("from_off") % BLOCK != 0) | (F.col("to_off") % BLOCK != 0) | ((F.col("length") % BLOCK != 0) & (F.col("from_off") + F.col("length") != F.col("from_size")))
    early = (
        F.when(~F.col("is_stage") & F.col("to_held"), "retained")
        .when(unaligned, "invalid")
        .when(F.col("is_stage") & (F.col("version") != F.col("to_version")), "stale")
        .when(F.col("from_off") >= F.col("from_size"), "none")
        .when(F.col("from_dir") | F.col("to_dir"), "directory")
        .when(F.col("from_off_blocks").isNotNull() | (F.col("to_off_blocks").isNotNull() & ~F.col("is_stage")), "no data")
    )
    first, to_first = F.call_function("div", F.col("from_off"), F.lit(BLOCK)), F.call_function("div", F.col("to_off"), F.lit(BLOCK))
    rows = rows.select("ino", "to_ino", "is_stage", first.alias("first"), (first + _up(inside)).alias("end"), to_first.alias("to_first"), early.alias("early"))
    # A piece is told by both its ends: an object that the requests name with two sizes is clipped twice.
    p = move(deal(extents, "ino"), rows.where("early is null")).select(F.col("ino").alias("to_ino"), F.col("start").alias("lo"), (F.col("start") + F.col("len")).alias("hi"))
    there = deal(extents, "ino").select(F.col("ino").alias("to_ino"), "start", (F.col("start") + F.col("len")).alias("stop"), "flags")
    met = p.join(there, "to_ino", "left")
    over = F.coalesce((F.col("start") < F.col("hi")) & (F.col("stop") > F.col("lo")), F.lit(False))
    within = F.coalesce((F.col("start") <= F.col("lo")) & (F.col("stop") >= F.col("hi")) & (F.col("flags").bitwiseAND(OFFLINE) != 0), F.lit(False))
    found = met.groupBy("to_ino", "lo", "hi").agg(F.bool_or(over).alias("over"), F.bool_or(within).alias("within")).groupBy("to_ino").agg(F.bool_or("over").alias("over"), F.bool_and("within").alias("within"))
    rows = rows.join(found, "to_ino", "left")
    late = F.when(F.col("is_stage") & ~F.coalesce("within", F.lit(True)), "not offline").when(~F.col("is_stage") & F.coalesce("over", F.lit(False)), "overlaps").otherwise("moved")
    return rows.select("ino", "to_ino", "is_stage", "first", "end", "to_first", F.coalesce("early", late).alias("status"))


def move_checked(extents: DataFrame, requests: DataFrame, inodes: DataFrame, deal: Callable[..., DataFrame] = _as_it_is) -> DataFrame:
    """Extents after the moves that are right; a staging move keeps its target's offline blocks where the source has none.

    The moves and their pieces are written, as both are used twice.
    """
    ok = written(move_status(extents, requests, inodes, deal).where("status = 'moved'").select("ino", "to_ino", "first", "end", "to_first"))
    new = written(move(deal(extents, "ino"), ok))
    taken = ok.select("ino", "first", "end").unionByName(new.select("ino", F.col("start").alias("first"), (F.col("start") + F.col("len")).alias("end")))
    return coalesce(deal(subtract(deal(extents, "ino"), taken).unionByName(new), "ino"))
