"""Name tree and extents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extents, index, tree
from ..sources.tables import Tables
from .catalog import query

_UP = "u AS (SELECT ino, dir_ino AS ancestor, 1::BIGINT AS depth FROM dirents UNION ALL SELECT u.ino, d.dir_ino, u.depth + 1 FROM u JOIN dirents d ON d.ino = u.ancestor)"


@query("s10_referring_entries", "SELECT ino, dir_ino, pos, name, type, lead(pos) OVER (PARTITION BY ino ORDER BY dir_ino, pos) IS NULL AS is_last FROM dirents", "dirents")
def referring(t: Tables) -> DataFrame:
    return index.with_last_flag(t.dirents(), ["ino"], ["dir_ino", "pos"]).select("ino", "dir_ino", "pos", "name", "type", "is_last")


@query("w03_last_in_directory", "SELECT dir_ino, pos, ino, lead(pos) OVER (PARTITION BY dir_ino ORDER BY pos) IS NULL AS is_last FROM dirents", "dirents")
def last_entry(t: Tables) -> DataFrame:
    return index.with_last_flag(t.dirents().select("dir_ino", "pos", "ino"), ["dir_ino"], ["pos"])


_ABOVE = f"WITH {_UP}, a AS (SELECT DISTINCT l.ino, u.ancestor, u.depth + 1 AS depth FROM links l JOIN u ON u.ino = l.dir_ino UNION SELECT ino, dir_ino, 1 FROM links UNION SELECT ino, ino, 0 FROM links)"
_PATHS = "c AS (SELECT ino, '/' || name AS path FROM dirents WHERE dir_ino = 1 UNION ALL SELECT d.ino, c.path || '/' || d.name FROM c JOIN dirents d ON d.dir_ino = c.ino), p AS (SELECT l.ino, l.dir_ino, l.pos, coalesce(c.path, '') || '/' || l.name AS path FROM links l LEFT JOIN c ON c.ino = l.dir_ino WHERE l.dir_ino = 1 OR c.ino IS NOT NULL)"


@query("j06_closure", f"{_ABOVE} SELECT ino, ancestor, depth FROM a", "links", recursive=True)
def closure(t: Tables) -> DataFrame:
    return tree.ancestors(t.links())


@query("s11_ino_path", f"WITH {_PATHS} SELECT * FROM p", "links", recursive=True)
def path(t: Tables) -> DataFrame:
    return tree.paths(t.links())


@query("s11_next_path", f"WITH {_PATHS}, q AS (SELECT ino, min(dir_ino) AS from_dir, arg_min(pos, (dir_ino, pos)) + 1 AS from_pos FROM links GROUP BY ino) SELECT q.ino, from_dir, from_pos, p.dir_ino, p.pos, p.path FROM q JOIN p ON p.ino = q.ino AND (p.dir_ino, p.pos) >= (from_dir, from_pos) QUALIFY row_number() OVER (PARTITION BY q.ino ORDER BY p.dir_ino, p.pos) = 1", "links", recursive=True)
def next_path(t: Tables) -> DataFrame:
    """The path that follows an object's first link."""
    first = t.links().groupBy("ino").agg(F.min(F.struct("dir_ino", "pos")).alias("l"))
    return tree.next_path(t.links(), first.select("ino", "l.dir_ino", (F.col("l.pos") + 1).alias("pos")))


@query("d19_rename_check", f"{_ABOVE}, m AS (SELECT ino, ino * 2 + ino % 3 AS to_dir FROM dirents) SELECT m.ino, m.to_dir, m.ino <> m.to_dir AND NOT EXISTS (SELECT 1 FROM a WHERE a.ino = m.to_dir AND a.ancestor = m.ino) AS allowed FROM m", "links", recursive=True)
def rename(t: Tables) -> DataFrame:
    moves = t.dirents().select("ino", (F.col("ino") * 2 + F.col("ino") % 3).alias("to_dir"))
    return tree.rename_allowed(t.links(), moves)


@query("j14_common_ancestor", f"WITH {_UP}, a AS (SELECT ino, ancestor FROM u UNION ALL SELECT ino, ino FROM dirents), p AS (SELECT ino AS x, ino + 1 AS y FROM dirents WHERE ino % 5 = 0) SELECT p.x, p.y, max(a.ancestor) AS ancestor FROM p JOIN a ON a.ino = p.x JOIN a AS b ON b.ino = p.y AND b.ancestor = a.ancestor GROUP BY p.x, p.y", "dirents", recursive=True)
def common(t: Tables) -> DataFrame:
    pairs = t.dirents().where("ino % 5 = 0").select(F.col("ino").alias("x"), (F.col("ino") + 1).alias("y"))
    return tree.common_ancestors(t.dirents(), pairs)


@query("s21_readdir", "SELECT dir_ino, pos, ino, name FROM dirents WHERE pos >= 2", "dirents")
def readdir(t: Tables) -> DataFrame:
    return t.dirents().where("pos >= 2").select("dir_ino", "pos", "ino", "name").orderBy("dir_ino", "pos")


@query("s22_lookup", "SELECT d.dir_ino, d.name, d.ino FROM dirents d JOIN (SELECT DISTINCT dir_ino, name FROM dirents WHERE ino % 11 = 0) q USING (dir_ino, name)", "dirents")
def lookup(t: Tables) -> DataFrame:
    wanted = t.dirents().where("ino % 11 = 0").select("dir_ino", "name").distinct()
    return t.dirents().join(wanted, ["dir_ino", "name"]).select("dir_ino", "name", "ino")


@query("j01_entry_to_inode", "SELECT d.dir_ino, d.name, i.ino, i.size FROM dirents d JOIN inodes i USING (ino)", "dirents", "inodes")
def entry_inode(t: Tables) -> DataFrame:
    return t.dirents().join(t.inodes(), "ino").select("dir_ino", "name", "ino", "size")


@query("d18_entry_add_delete", "SELECT dir_ino, pos, name, ino FROM dirents WHERE ino % 6 <> 0 UNION ALL SELECT dir_ino, pos + 100, name || '.new', ino FROM dirents WHERE ino % 6 = 1", "dirents")
def entries(t: Tables) -> DataFrame:
    d = t.dirents().select("dir_ino", "pos", "name", "ino")
    gone, new = d.where("ino % 6 = 0"), d.where("ino % 6 = 1")
    return d.join(gone.select("ino"), "ino", "left_anti").select(*d.columns).unionByName(new.select("dir_ino", (F.col("pos") + 100).alias("pos"), F.concat("name", F.lit(".new")).alias("name"), "ino"))


@query("a16_order_statistic", "SELECT dir_ino, pos, ino FROM dirents QUALIFY row_number() OVER (PARTITION BY dir_ino ORDER BY pos) = 2", "dirents")
def order_statistic(t: Tables) -> DataFrame:
    return index.entry_at(t.dirents().select("dir_ino", "pos", "ino"), ["dir_ino"], ["pos"], 1)


# ---- extents


def _ranges(t: Tables) -> DataFrame:
    return t.mapped().groupBy("ino").agg(F.max(F.col("start") + F.col("len")).alias("e")).select("ino", F.call_function("div", "e", F.lit(4)).alias("first"), F.call_function("div", F.col("e") * 3, F.lit(4)).alias("end")).where("first < end")


_RANGE = 'r AS (SELECT ino, max(start + len) // 4 AS a, max(start + len) * 3 // 4 AS b FROM mapped GROUP BY ino HAVING max(start + len) // 4 < max(start + len) * 3 // 4)'
#: One row for each block: the plainest model of an interval.
_BLOCKS = "k AS (SELECT ino, unnest(generate_series(start, start + len - 1)) AS blk, start, map, flags FROM mapped), q AS (SELECT k.ino, blk, CASE WHEN map = 0 THEN 0 ELSE map + blk - start END AS map, flags, coalesce(blk >= a AND blk < b, false) AS hit, a, b FROM k LEFT JOIN r ON r.ino = k.ino)"
#: Blocks joined again into extents, after a table z(ino, blk, map, flags).
_JOIN = """y AS (SELECT *, CASE WHEN lag(blk) OVER w = blk - 1 AND lag(flags) OVER w = flags AND ((map = 0 AND lag(map) OVER w = 0) OR (map <> 0 AND lag(map) OVER w <> 0 AND lag(map) OVER w = map - 1)) THEN 0 ELSE 1 END AS fresh FROM z WINDOW w AS (PARTITION BY ino ORDER BY blk)),
 x AS (SELECT *, sum(fresh) OVER (PARTITION BY ino ORDER BY blk) AS isl FROM y) SELECT ino, min(blk)::BIGINT AS start, count(*) AS len, min(map)::BIGINT AS map, min(flags)::BIGINT AS flags FROM x GROUP BY ino, isl"""


@query("w04_coalesce", f"WITH z AS (SELECT ino, unnest(generate_series(start, start + len - 1)) AS blk, 0::BIGINT AS map, flags FROM extents), {_JOIN}", "extents")
def coalesce(t: Tables) -> DataFrame:
    return extents.coalesce(t.extents())


@query("e01_coalesce_mapped", f"WITH {_RANGE}, {_BLOCKS}, z AS (SELECT ino, blk, map, flags FROM q), {_JOIN}", "mapped")
def coalesce_mapped(t: Tables) -> DataFrame:
    return extents.coalesce(t.mapped())


@query("e05_release", f"WITH {_RANGE}, {_BLOCKS}, z AS (SELECT ino, blk, CASE WHEN hit THEN 0 ELSE map END AS map, CASE WHEN hit THEN 1 ELSE flags END AS flags FROM q), {_JOIN}", "mapped")
def release(t: Tables) -> DataFrame:
    return extents.release(t.mapped(), _ranges(t))


@query("d11_stage", f"WITH {_RANGE}, {_BLOCKS}, z AS (SELECT ino, blk, CASE WHEN hit AND flags = 1 THEN 900000 + blk - a ELSE map END AS map, CASE WHEN hit AND flags = 1 THEN 0 ELSE flags END AS flags FROM q), {_JOIN}", "mapped")
def stage(t: Tables) -> DataFrame:
    return extents.stage(t.mapped(), _ranges(t).withColumn("to_map", F.lit(900_000).cast("long")))


@query("e03_remove", f"WITH {_RANGE}, {_BLOCKS}, z AS (SELECT ino, blk, map, flags FROM q WHERE NOT hit), {_JOIN}", "mapped")
def remove(t: Tables) -> DataFrame:
    return extents.coalesce(extents.remove(t.mapped(), _ranges(t)))


@query("e06_punch_offline", f"WITH {_RANGE}, {_BLOCKS}, n AS (SELECT DISTINCT ino FROM q WHERE hit AND map <> 0), z AS (SELECT ino, blk, map, flags FROM q WHERE NOT (hit AND flags = 1 AND ino NOT IN (SELECT ino FROM n))), {_JOIN}", "mapped")
def punch(t: Tables) -> DataFrame:
    return extents.punch_offline(t.mapped(), _ranges(t))


def _inner(t: Tables) -> DataFrame:
    """One block of one extent of each object, and for some objects a range across extents."""
    first = t.mapped().groupBy("ino").agg(F.min("start").alias("s"), F.min_by("len", "start").alias("l"))
    end = F.when(F.col("ino") % 3 == 0, F.col("s") + F.col("l") + 1).otherwise(F.col("s") + F.col("l"))
    return first.select("ino", (F.col("s") + F.col("l") - 1).alias("first"), end.alias("end"), F.lit(0).cast("long").alias("set_map"), F.lit(1).cast("long").alias("set_flags"))


@query(
    "e04_set",
    f"WITH {_RANGE}, {_BLOCKS}, f AS (SELECT ino, min(start) + arg_min(len, start) - 1 AS a, min(start) + arg_min(len, start) + CASE WHEN ino % 3 = 0 THEN 1 ELSE 0 END AS b FROM mapped GROUP BY ino), bad AS (SELECT DISTINCT m.ino FROM mapped m JOIN f USING (ino) WHERE start < b AND start + len > a AND (start > a OR start + len < b)), z AS (SELECT q.ino, blk, CASE WHEN h THEN 0 ELSE map END AS map, CASE WHEN h THEN 1 ELSE flags END AS flags FROM (SELECT q.*, blk >= f.a AND blk < f.b AND q.ino NOT IN (SELECT ino FROM bad) AS h FROM q JOIN f USING (ino)) q UNION ALL SELECT ino, a, 0, 1 FROM f WHERE false), {_JOIN}",
    "mapped",
)
def set_range(t: Tables) -> DataFrame:
    # Objects of one extent whose range runs past its end are refused like the others.
    return extents.set_range(t.mapped(), _inner(t))


@query("e02_insert_conflicts", f"WITH {_RANGE} SELECT r.ino, r.a AS start, (r.b - r.a)::BIGINT AS len FROM r WHERE EXISTS (SELECT 1 FROM mapped m WHERE m.ino = r.ino AND m.start < r.b AND m.start + m.len > r.a)", "mapped")
def conflicts(t: Tables) -> DataFrame:
    return extents.insert_conflicts(t.mapped(), _ranges(t).select("ino", F.col("first").alias("start"), (F.col("end") - F.col("first")).alias("len")))


@query("e07_move", f"WITH {_RANGE} SELECT m.ino + 5000000 AS ino, (greatest(start, a) - a + 7)::BIGINT AS start, (least(start + len, b) - greatest(start, a))::BIGINT AS len, (CASE WHEN map = 0 THEN 0 ELSE map + greatest(start, a) - start END)::BIGINT AS map, flags FROM mapped m JOIN r USING (ino) WHERE start < b AND start + len > a", "mapped")
def move(t: Tables) -> DataFrame:
    return extents.move(t.mapped(), _ranges(t).select("ino", (F.col("ino") + 5_000_000).alias("to_ino"), "first", "end", F.lit(7).cast("long").alias("to_first")))


@query("s23_fiemap", "SELECT ino, greatest(start, 10) AS start, least(start + len, 40) - greatest(start, 10) AS len, (CASE WHEN map = 0 THEN 0 ELSE map + greatest(start, 10) - start END)::BIGINT AS map, flags FROM mapped WHERE start < 40 AND start + len > 10", "mapped")
def fiemap(t: Tables) -> DataFrame:
    return extents.clip(t.mapped(), F.lit(10).cast("long"), F.lit(40).cast("long"))


@query("s24_states", "SELECT CASE WHEN (flags & 1) <> 0 THEN 'OFFLINE' WHEN (flags & 2) <> 0 THEN 'UNWRITTEN' WHEN map <> 0 THEN 'MAPPED' ELSE 'HOLE' END AS state, count(*) AS n, sum(len)::BIGINT AS blocks FROM mapped GROUP BY 1", "mapped")
def states(t: Tables) -> DataFrame:
    return t.mapped().groupBy(extents.state(F.col("map"), F.col("flags")).alias("state")).agg(F.count("*").alias("n"), F.sum("len").alias("blocks"))


@query("s25_seek_data", "SELECT ino, min(greatest(start, 20)) AS data_at FROM mapped WHERE start + len > 20 AND flags <> 2 GROUP BY ino", "mapped")
def seek(t: Tables) -> DataFrame:
    """The first block at or after 20 that holds data, here or offline; unwritten blocks are holes."""
    return t.mapped().where("start + len > 20 and flags <> 2").groupBy("ino").agg(F.min(F.greatest("start", F.lit(20))).alias("data_at"))


@query("s25_seek_hole", "WITH k AS (SELECT ino, unnest(generate_series(start, start + len - 1)) AS blk FROM mapped WHERE flags <> 2), g AS (SELECT ino, max(start + len) AS e FROM mapped GROUP BY ino), c AS (SELECT g.ino, unnest(generate_series(20, greatest(e, 20))) AS blk FROM g) SELECT c.ino, min(c.blk)::BIGINT AS hole_at FROM c LEFT JOIN k ON k.ino = c.ino AND k.blk = c.blk WHERE k.blk IS NULL GROUP BY c.ino", "mapped")
def seek_hole(t: Tables) -> DataFrame:
    """The first block at or after 20 without data: 20 itself, or the end of a run of data."""
    m = t.mapped()
    runs = extents.coalesce(m.where("flags <> 2").withColumn("map", F.lit(0).cast("long")).withColumn("flags", F.lit(0).cast("long")))
    covering = runs.where("start <= 20 and start + len > 20").select("ino", (F.col("start") + F.col("len")).alias("hole_at"))
    return m.select("ino").distinct().join(covering, "ino", "left").select("ino", F.coalesce("hole_at", F.lit(20)).alias("hole_at"))


@query("a13_online_offline", "SELECT ino, coalesce(sum(len) FILTER (map <> 0 AND (flags & 2) = 0), 0)::BIGINT AS online, coalesce(sum(len) FILTER (NOT (map <> 0 AND (flags & 2) = 0) AND (flags & 1) <> 0), 0)::BIGINT AS offline FROM mapped GROUP BY ino", "mapped")
def on_off(t: Tables) -> DataFrame:
    return extents.on_off(t.mapped())


@query("e08_take_first", "WITH b AS (SELECT *, sum(len) OVER (PARTITION BY ino ORDER BY start) - len AS before FROM mapped) SELECT ino, start, least(len, 60 - before)::BIGINT AS len, map, flags FROM b WHERE before < 60", "mapped")
def take(t: Tables) -> DataFrame:
    return extents.take_until(t.mapped(), ["start"], 60)


@query("e13_move_until_total", "WITH b AS (SELECT *, sum(len) OVER (PARTITION BY ino ORDER BY len DESC, start) - len AS before FROM mapped) SELECT ino, start, least(len, 80 - before)::BIGINT AS len, map, flags FROM b WHERE before < 80", "mapped")
def move_until(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.coalesce(F.sum("len").over(Window.partitionBy("ino").orderBy(F.desc("len"), "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.mapped().withColumn("before", before).where("before < 80").withColumn("len", F.least("len", 80 - F.col("before"))).drop("before")


@query("o07_largest_first", "SELECT ino, start, len FROM mapped QUALIFY row_number() OVER (PARTITION BY ino ORDER BY (length(ltrim(bin(len), '0')) - 1) // 3 DESC, start) = 1", "mapped")
def largest(t: Tables) -> DataFrame:
    rank = F.struct(extents.order_bucket(F.col("len")).alias("o"), (-F.col("start")).alias("s"))
    return t.mapped().groupBy("ino").agg(F.max_by(F.struct("start", "len"), rank).alias("e")).select("ino", "e.start", "e.len")


@query("e09_init_offline", "SELECT i.ino, 0::BIGINT AS start, (size + 4095) // 4096 AS len, 0::BIGINT AS map, 1::BIGINT AS flags FROM inodes i WHERE NOT is_dir AND size > 0 AND i.ino NOT IN (SELECT ino FROM extents)", "inodes", "extents")
def init_offline(t: Tables) -> DataFrame:
    new = t.inodes().where("not is_dir and size > 0").join(t.extents().select("ino").distinct(), "ino", "left_anti")
    zero = F.lit(0).cast("long")
    return new.select("ino", zero.alias("start"), F.call_function("div", F.col("size") + 4095, F.lit(4096)).alias("len"), zero.alias("map"), F.lit(1).cast("long").alias("flags"))


@query("e10_wait_check", f"WITH {_RANGE} SELECT r.ino, EXISTS (SELECT 1 FROM mapped m WHERE m.ino = r.ino AND m.start < r.b AND m.start + m.len > r.a AND (m.flags & 1) <> 0) AS must_wait FROM r", "mapped")
def wait_check(t: Tables) -> DataFrame:
    r = _ranges(t)
    hit = t.mapped().where("flags & 1 <> 0").join(r, "ino").where("start < end and start + len > first").select("ino", F.lit(True).alias("hit")).distinct()
    return r.join(hit, "ino", "left").select("ino", F.coalesce("hit", F.lit(False)).alias("must_wait"))


@query("e12_extent_keys", "SELECT ino, start + len - 1 AS last_block, len FROM mapped", "mapped")
def keys(t: Tables) -> DataFrame:
    return t.mapped().select("ino", (F.col("start") + F.col("len") - 1).alias("last_block"), "len")


@query("e17_exclusive_zones", "WITH z AS (SELECT DISTINCT ino % 7 AS rid, unnest(generate_series(start // 16, (start + len - 1) // 16)) + ino // 3 AS zone FROM mapped) SELECT zone, min(rid) AS rid FROM z GROUP BY zone HAVING count(*) = 1", "mapped")
def zones(t: Tables) -> DataFrame:
    """Zones that only one mount uses."""
    zone = F.explode(F.expr("sequence(start div 16, (start + len - 1) div 16)"))
    z = t.mapped().select((F.col("ino") % 7).alias("rid"), "ino", zone.alias("z")).select("rid", (F.col("z") + F.expr("ino div 3")).alias("zone"))
    # One mount only: its least is its greatest. No row for each zone and mount is kept.
    return z.groupBy("zone").agg(F.min("rid").alias("rid"), F.max("rid").alias("top")).where("rid <=> top").select("zone", "rid")


@query("e18_overlapping_locks", "WITH l AS (SELECT ino % 50 AS g, ino, meta_seq AS a, meta_seq + 3 AS b FROM inodes) SELECT DISTINCT x.ino FROM l x JOIN l y ON x.g = y.g AND x.ino <> y.ino AND x.a <= y.b AND y.a <= x.b", "inodes")
def overlapping(t: Tables) -> DataFrame:
    """Ranges of a group that overlap another: the first of two is met by the second's start.

    A range stands in each span of positions that it touches, and two that overlap share the span of the later start.
    So a window holds one span of a group, not the group, and no frame is scanned again for each row.
    """
    from pyspark.sql import Window

    rows = t.inodes().select((F.col("ino") % 50).alias("g"), "ino", F.col("meta_seq").alias("a"), (F.col("meta_seq") + 3).alias("b"))
    placed = rows.withColumn("span", F.explode(F.expr("sequence(a div 1024, b div 1024)")))
    w = Window.partitionBy("g", "span").orderBy("a", "ino")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("a")
    after = F.lead("a").over(w) <= F.col("b")
    return placed.withColumn("hit", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).where("hit").select("ino").distinct()
