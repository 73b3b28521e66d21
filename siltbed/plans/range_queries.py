"""Ranges, zones and bitmaps over extents; moves, releases and punches with their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extents, index
from ..sources.scratch import written
from ..sources.tables import Tables
from .catalog import query
from .object_queries import _BLOCKS, _JOIN, _RANGE, _ranges

_GUARDED = _RANGE.replace("FROM mapped GROUP BY", "FROM mapped WHERE ino IN (SELECT i.ino FROM inodes i WHERE data_version = 1 + i.ino % 3) GROUP BY")
_OVER = "m.ino = r.ino AND m.start < r.b AND m.start + m.len > r.a"


@query("d10_release", f"WITH {_GUARDED}, {_BLOCKS}, z AS (SELECT ino, blk, CASE WHEN hit THEN 0 ELSE map END AS map, CASE WHEN hit THEN 1 ELSE flags END AS flags FROM q), {_JOIN}", "mapped", "inodes")
def release(t: Tables) -> DataFrame:
    """A release with a stale data version changes nothing."""
    current = t.dealt(t.inodes().where("data_version = 1 + ino % 3").select("ino"), "lineitem", "ino")
    return extents.release(t.mapped(), _ranges(t).join(current, "ino", "left_semi"))


@query(
    "d12_move_blocks",
    f"WITH {_RANGE}, {_BLOCKS}, o AS (SELECT *, CASE WHEN ino % 2 = 0 THEN ino + 5000000 ELSE ino END AS target FROM q), z AS (SELECT ino, blk, map, flags FROM o WHERE NOT hit OR ino % 2 = 1 UNION ALL SELECT target, blk - a + 7, map, flags FROM o WHERE hit AND ino % 2 = 0), {_JOIN}",
    "mapped",
)
def move_blocks(t: Tables) -> DataFrame:
    """Even objects move a range to a new object; odd ones aim at their own first blocks, which are not empty."""
    odd = F.col("ino") % 2 == 1
    first = t.mapped().groupBy("ino").agg(F.min("start").alias("s"))
    moves = _ranges(t).join(first, "ino").select("ino", F.when(odd, F.col("ino")).otherwise(F.col("ino") + 5_000_000).alias("to_ino"), "first", "end", F.when(odd, F.col("s")).otherwise(7).cast("long").alias("to_first"))
    return extents.move_blocks(t.mapped(), moves, t.by_lines)


#: One row for each block of mapped, as k(ino, blk, map, flags).
_EACH = "k AS (SELECT ino, blk, CASE WHEN map = 0 THEN 0 ELSE map + blk - start END AS map, flags FROM (SELECT *, unnest(generate_series(start, start + len - 1)) AS blk FROM {0}))"


@query(
    "d10_release_checked",
    f"WITH {_EACH.format('mapped')}, r AS (SELECT ino, \"offset\" // 4096 AS a, (\"offset\" + length) // 4096 AS b, (size + 4095) // 4096 AS top FROM releases JOIN inodes USING (ino) WHERE version = data_version AND NOT is_dir AND length % 4096 = 0 AND \"offset\" % 4096 = 0),"
    f" h AS (SELECT k.ino, blk, CASE WHEN blk >= a AND blk < b THEN 0 ELSE map END AS map, CASE WHEN blk >= a AND blk < b THEN 1 ELSE flags END AS flags, top FROM k LEFT JOIN r ON r.ino = k.ino),"
    f" z AS (SELECT ino, blk, map, flags FROM (SELECT *, bool_or(map <> 0 AND flags & 2 = 0) OVER (PARTITION BY ino) AS live FROM h) WHERE live OR top IS NULL OR top = 0 OR blk < top), {_JOIN}",
    "mapped",
    "inodes",
    "releases",
)
def release_checked(t: Tables) -> DataFrame:
    """In bytes, under the data version; objects left without online blocks end at their size."""
    return extents.release_checked(t.mapped(), *[t.dealt(x, "lineitem", "ino") for x in (t.releases(), t.inodes())])


_STAGED = "s AS (SELECT *, \"offset\" + length AS stop, CASE WHEN length < 0 OR \"offset\" % 4096 <> 0 THEN 'invalid' WHEN length = 0 THEN 'none' WHEN is_dir OR \"offset\" + length > size OR ((\"offset\" + length) % 4096 <> 0 AND \"offset\" + length <> size) THEN 'invalid' WHEN version <> data_version THEN 'stale' ELSE 'ok' END AS status FROM stages JOIN inodes USING (ino))"


@query("d11_stage_status", f"WITH {_STAGED.replace('version <> data_version', 's.version <> data_version').replace('FROM stages', 'FROM stages s')} SELECT ino, status FROM s", "inodes", "stages")
def stage_status(t: Tables) -> DataFrame:
    return extents.stage_status(t.stages(), t.inodes()).select("ino", "status")


@query(
    "d11_stage_checked",
    f"WITH {_EACH.format('mapped')}, {_STAGED}, r AS (SELECT ino, \"offset\" // 4096 AS a, (stop + 4095) // 4096 AS b FROM s WHERE status = 'ok'), z AS (SELECT k.ino, blk, CASE WHEN flags = 1 AND blk >= a AND blk < b THEN 900000 + blk - a ELSE map END AS map, CASE WHEN flags = 1 AND blk >= a AND blk < b THEN 0 ELSE flags END AS flags FROM k LEFT JOIN r ON r.ino = k.ino), {_JOIN}",
    "mapped",
    "inodes",
    "stages",
)
def stage_checked(t: Tables) -> DataFrame:
    """In bytes, inside the size, under the data version; others change nothing."""
    return extents.stage_checked(t.mapped(), *[t.dealt(x, "lineitem", "ino") for x in (t.stages(), t.inodes())])


_MOVED = (
    "o AS (SELECT ino, sum(len) FILTER (flags & 1 <> 0 AND NOT (map <> 0 AND flags & 2 = 0)) > 0 AS off FROM move_extents GROUP BY ino),"
    " v AS (SELECT m.*, f.size, from_off // 4096 AS a, from_off // 4096 + (least(length, f.size - from_off) + 4095) // 4096 AS b, CASE WHEN NOT is_stage AND g.flags & 2 <> 0 THEN 'retained' WHEN from_off % 4096 <> 0 OR (length % 4096 <> 0 AND from_off + length <> f.size) THEN 'invalid' WHEN is_stage AND m.version <> g.data_version THEN 'stale'"
    " WHEN from_off >= f.size THEN 'none' WHEN f.is_dir OR g.is_dir THEN 'directory' WHEN x.off OR (y.off AND NOT is_stage) THEN 'no data' END AS early FROM moves m JOIN move_targets f ON f.ino = m.ino JOIN move_targets g ON g.ino = m.to_ino LEFT JOIN o x ON x.ino = m.ino LEFT JOIN o y ON y.ino = m.to_ino),"
    " p AS (SELECT v.ino, v.to_ino, is_stage, greatest(start, a) - a + 2 AS lo, least(start + len, b) - a + 2 AS hi FROM v JOIN move_extents e ON e.ino = v.ino AND start < b AND start + len > a WHERE early IS NULL),"
    " c AS (SELECT ino, bool_or(CASE WHEN is_stage THEN NOT EXISTS (SELECT 1 FROM move_extents e WHERE e.ino = p.to_ino AND start <= lo AND start + len >= hi AND flags & 1 <> 0) ELSE EXISTS (SELECT 1 FROM move_extents e WHERE e.ino = p.to_ino AND start < hi AND start + len > lo) END) AS bad FROM p GROUP BY ino),"
    " t AS (SELECT v.*, coalesce(early, CASE WHEN bad THEN CASE WHEN is_stage THEN 'not offline' ELSE 'overlaps' END ELSE 'moved' END) AS status FROM v LEFT JOIN c ON c.ino = v.ino)"
)


@query("d12_move_status", f"WITH {_MOVED} SELECT ino, to_ino, is_stage, status FROM t", "inodes", "move_targets", "move_extents", "moves")
def move_status(t: Tables) -> DataFrame:
    return extents.move_status(written(t.move_extents()), t.moves(), t.move_targets(), t.by_lines).select("ino", "to_ino", "is_stage", "status")


@query(
    "d12_move_checked",
    f"WITH {_MOVED}, {_EACH.format('move_extents')}, g AS (SELECT k.*, t.to_ino, blk - a + 2 AS to_blk FROM k LEFT JOIN t ON t.ino = k.ino AND status = 'moved' AND blk >= a AND blk < b), n AS (SELECT to_ino AS ino, to_blk AS blk, map, flags FROM g WHERE to_ino IS NOT NULL), z AS (SELECT ino, blk, map, flags FROM g WHERE to_ino IS NULL AND (ino, blk) NOT IN (SELECT (ino, blk) FROM n) UNION ALL SELECT * FROM n), {_JOIN}",
    "inodes",
    "move_targets",
    "move_extents",
    "moves",
)
def move_checked(t: Tables) -> DataFrame:
    """Clipped to the size; plain into free blocks, staging into offline ones."""
    return extents.move_checked(written(t.move_extents()), t.moves(), t.move_targets(), t.by_lines)


@query("d13_punch_status", f"WITH {_RANGE} SELECT r.ino, CASE WHEN EXISTS (SELECT 1 FROM mapped m WHERE {_OVER} AND map <> 0) THEN 'refused' ELSE 'punched' END AS status FROM r", "mapped")
def punch_status(t: Tables) -> DataFrame:
    r = _ranges(t)
    stored = extents.next_overlapping(t.mapped().where("map <> 0"), r).select("ino", F.lit("refused").alias("status"))
    return r.join(stored, "ino", "left").select("ino", F.coalesce("status", F.lit("punched")).alias("status"))


@query("e11_shifted_map", "SELECT ino, start, len, CASE WHEN map = 0 THEN 0 ELSE map + 4096 END AS map FROM mapped", "mapped")
def shifted(t: Tables) -> DataFrame:
    return t.mapped().select("ino", "start", "len", extents.shifted(F.col("map"), F.lit(4096)).alias("map"))


@query(
    "e14_newest_ranges",
    """WITH g AS (SELECT ino, id * 10 AS first, id * 10 + val AS "end", val * 100 + id AS read_seq FROM tags),
 k AS (SELECT ino, blk, max(read_seq) AS read_seq FROM (SELECT ino, unnest(generate_series(first, "end" - 1)) AS blk, read_seq FROM g) GROUP BY ino, blk),
 y AS (SELECT *, CASE WHEN lag(blk) OVER w = blk - 1 AND lag(read_seq) OVER w = read_seq THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY ino ORDER BY blk)),
 x AS (SELECT *, sum(fresh) OVER (PARTITION BY ino ORDER BY blk) AS run FROM y)
 SELECT ino, min(blk)::BIGINT AS first, max(blk)::BIGINT + 1 AS "end", min(read_seq) AS read_seq FROM x GROUP BY ino, run""",
    "tags",
)
def newest_ranges(t: Tables) -> DataFrame:
    return extents.newest_ranges(t.tags(dealt=True).select("ino", (F.col("id") * 10).alias("first"), (F.col("id") * 10 + F.col("val")).alias("end"), (F.col("val") * 100 + F.col("id")).alias("read_seq")))


@query("e15_covered", f"WITH {_RANGE}, {_BLOCKS} SELECT ino, count(*) = max(b) - max(a) AS covered, bool_or(flags = 2) AS dirty FROM q WHERE hit GROUP BY ino UNION ALL SELECT ino, false, false FROM r WHERE ino NOT IN (SELECT ino FROM q WHERE hit)", "mapped")
def covered(t: Tables) -> DataFrame:
    return extents.covered(t.mapped(), _ranges(t))


@query(
    "e16_invalidate",
    f"""WITH {_RANGE}, p AS (SELECT m.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce({_OVER}, false) AS hit FROM mapped m LEFT JOIN r ON r.ino = m.ino)
 SELECT ino, start, len, map, flags FROM p WHERE NOT hit
 UNION ALL SELECT ino, start, (a - start)::BIGINT, map, flags FROM p WHERE hit AND start < a
 UNION ALL SELECT ino, b::BIGINT, (start + len - b)::BIGINT, CASE WHEN map = 0 THEN 0 ELSE (map + b - start)::BIGINT END, flags FROM p WHERE hit AND start + len > b""",
    "mapped",
)
def invalidate(t: Tables) -> DataFrame:
    return extents.remove(t.mapped(), _ranges(t))


@query("j04_next_overlapping", f"WITH {_RANGE} SELECT r.ino, r.a::BIGINT AS first, r.b::BIGINT AS \"end\", min(m.start) AS start, arg_min(m.len, m.start) AS len FROM r JOIN mapped m ON {_OVER} GROUP BY r.ino, r.a, r.b", "mapped")
def next_overlapping(t: Tables) -> DataFrame:
    return extents.next_overlapping(t.mapped(), _ranges(t))


@query("j05_contained", f"WITH {_RANGE} SELECT r.ino, m.start, m.len FROM r JOIN mapped m ON m.ino = r.ino AND m.start <= r.a AND m.start + m.len >= r.b", "mapped")
def contained(t: Tables) -> DataFrame:
    return _ranges(t).join(t.mapped(), "ino").where("start <= first and start + len >= end").select("ino", "start", "len")


@query("j12_zone_extents", "WITH z AS (SELECT ino, start, len, unnest(generate_series(start // 16, (start + len - 1) // 16)) AS zone FROM mapped WHERE map = 0) SELECT zone % 7 AS rid, ino, start, len FROM z QUALIFY row_number() OVER (PARTITION BY zone % 7 ORDER BY (length(ltrim(bin(len), '0')) - 1) // 3 DESC, ino, start) = 1", "mapped")
def zone_extents(t: Tables) -> DataFrame:
    """For each mount the largest free extent that touches one of its zones."""
    z = extents.zones_of(t.mapped().where("map = 0")).withColumn("rid", F.col("zone") % 7)
    rank = F.struct((-extents.order_bucket(F.col("len"))).alias("o"), "ino", "start")
    return z.groupBy("rid").agg(F.min_by(F.struct("ino", "start", "len"), rank).alias("e")).select("rid", "e.*")


@query("u04_intersection", f"WITH {_RANGE} SELECT r.ino, greatest(m.start, r.a)::BIGINT AS first, least(m.start + m.len, r.b)::BIGINT AS \"end\" FROM r JOIN mapped m ON {_OVER}", "mapped")
def intersection(t: Tables) -> DataFrame:
    both = t.mapped().join(_ranges(t), "ino").where("start < end and start + len > first")
    return both.select("ino", F.greatest("start", "first").alias("first"), F.least(F.col("start") + F.col("len"), F.col("end")).alias("end"))


@query("p02_range_overlap", "SELECT ino, start, start + len - 1 AS last FROM mapped WHERE start <= 30 AND start + len - 1 >= 12", "mapped")
def range_overlap(t: Tables) -> DataFrame:
    return t.mapped().where("start <= 30 and start + len - 1 >= 12").select("ino", "start", (F.col("start") + F.col("len") - 1).alias("last"))


_WORDS = "ino // 32 AS word, bit_or(1::BIGINT << (ino % 32)::INT) AS bits, bit_count(bit_or(1::BIGINT << (ino % 32)::INT))::BIGINT AS n_set"


@query("a18_bitmap", f"SELECT ino // 1024 AS grp, {_WORDS} FROM inodes GROUP BY ALL", "inodes")
def bitmap(t: Tables) -> DataFrame:
    return index.bitmap(t.inodes().select(index.group_of(F.col("ino")).alias("grp"), "ino"), ["grp"], F.col("ino"))


@query("u05_open_bitmaps", f"SELECT {_WORDS} FROM mounts GROUP BY ALL", "mounts")
def open_bitmaps(t: Tables) -> DataFrame:
    """What any mount holds open: the words of each mount first, then one OR over the mounts."""
    own = index.bitmap(t.mounts(), ["rid"], F.col("ino"))
    return own.groupBy("word").agg(F.bit_or("bits").alias("bits")).select("word", "bits", F.bit_count("bits").cast("long").alias("n_set"))


@query("s14_all_allocators", "SELECT CASE id % 5 WHEN 0 THEN 'server' WHEN 1 THEN 'mount' WHEN 2 THEN 'search' WHEN 3 THEN 'merge' ELSE 'super' END AS owner, meta, avail, sum(blocks)::BIGINT AS blocks FROM alloc GROUP BY ALL", "alloc")
def all_allocators(t: Tables) -> DataFrame:
    owner = F.element_at(F.array(*map(F.lit, ("server", "mount", "search", "merge", "super"))), (F.col("id") % 5 + 1).cast("int"))
    return t.alloc().groupBy(owner.alias("owner"), "meta", "avail").agg(F.sum("blocks").alias("blocks"))


@query("s15_allocator_extents", "SELECT ino, start, len FROM mapped WHERE map = 0 AND ino % 12 = 5", "mapped")
def allocator_extents(t: Tables) -> DataFrame:
    """Free extents of one allocator."""
    return t.mapped().where("map = 0 and ino % 12 = 5").select("ino", "start", "len")


@query("s18_statfs_more", "SELECT (SELECT sum(blocks) FROM alloc WHERE meta)::BIGINT AS total_meta, (SELECT sum(blocks) FROM alloc WHERE NOT meta)::BIGINT AS total_data, (SELECT max(commit_trans_seq) FROM open_trans) AS committed_seq, 64::BIGINT AS reserved_meta", "alloc", "open_trans")
def statfs_more(t: Tables) -> DataFrame:
    blocks = t.alloc().agg(F.sum(F.when(F.col("meta"), F.col("blocks"))).alias("total_meta"), F.sum(F.when(~F.col("meta"), F.col("blocks"))).alias("total_data"))
    seq = t.open_trans().agg(F.max("commit_trans_seq").alias("committed_seq"))
    one = F.lit(1).alias("one")  # both sides are one row
    return blocks.select(one, "*").join(seq.select(one, "*"), "one").select("total_meta", "total_data", "committed_seq", F.lit(64).cast("long").alias("reserved_meta"))


@query("a15_wait_masks", "SELECT ino, iblock, bit_or(op) AS mask, count(*) AS waiting FROM waiters GROUP BY ino, iblock", "waiters")
def wait_masks(t: Tables) -> DataFrame:
    return t.waiters().groupBy("ino", "iblock").agg(F.bit_or("op").alias("mask"), F.count("*").alias("waiting"))


@query("t11_orphan_scan", "SELECT ino // 1024 AS grp, count(*) AS n, min(ino) AS first FROM orphans WHERE ino NOT IN (SELECT ino FROM open_inos) GROUP BY 1", "orphans", "open_inos")
def orphan_scan(t: Tables) -> DataFrame:
    """What one pass would delete, by group of objects."""
    gone = t.orphans().join(t.open_inos(), "ino", "left_anti")
    return gone.groupBy(index.group_of(F.col("ino")).alias("grp")).agg(F.count("*").alias("n"), F.min("ino").alias("first"))
