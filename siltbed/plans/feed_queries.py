"""Change feed, merges, totals, search and attribute index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forest, index, search, totals
from ..sources.tables import Tables
from .catalog import query

LAST = 1_000_000_000
_STABLE = "w AS (SELECT least(1000000000, coalesce(min(get_trans_seq) FILTER (get_trans_seq > commit_trans_seq AND mounted) - 1, 1000000000)) AS stable_seq FROM (SELECT * FROM open_trans QUALIFY row_number() OVER (PARTITION BY rid ORDER BY nr DESC) = 1))"
_NEWEST = "SELECT * FROM item_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, source) = 1"


@query("s01_walk_meta_seq", "SELECT major, minor, ino FROM seq_index WHERE index = 'meta_seq' AND major BETWEEN 100 AND 5000", "seq_index")
def walk_meta(t: Tables) -> DataFrame:
    return index.walk(t.seq_index(), "meta_seq", (100, 0, 0), (5000, 0, LAST))


@query("s01_walk_data_seq", "SELECT major, minor, ino FROM seq_index WHERE index = 'data_seq'", "seq_index")
def walk_data(t: Tables) -> DataFrame:
    return index.walk(t.seq_index(), "data_seq", (0, 0, 0), (LAST, 0, LAST))


@query("s02_walk_below_watermark", f"WITH {_STABLE} SELECT major, minor, ino FROM seq_index, w WHERE index = 'meta_seq' AND major <= stable_seq", "seq_index", "open_trans")
def walk_stable(t: Tables) -> DataFrame:
    return index.walk(t.seq_index(), "meta_seq", (0, 0, 0), (LAST, 0, LAST), watermark=index.stable_seq(t.open_trans(), LAST))


@query("s03_walk_reversed", "SELECT major, minor, ino FROM seq_index WHERE false", "seq_index")
def walk_reversed(t: Tables) -> DataFrame:
    return index.walk(t.seq_index(), "meta_seq", (50, 0, 0), (10, 0, 0))


@query("o05_keyset_page", "SELECT major, minor, ino FROM seq_index WHERE index = 'meta_seq' AND (major, minor, ino) > (777, 0, 0) ORDER BY ALL LIMIT 128", "seq_index")
def page(t: Tables) -> DataFrame:
    """One page after a cursor: a limit is the feature."""
    return index.walk(t.seq_index(), "meta_seq", (777, 0, 1), (LAST, 0, LAST), limit=128)


@query("a12_stable_seq", f"WITH {_STABLE} SELECT stable_seq::BIGINT AS stable_seq FROM w", "open_trans")
def stable(t: Tables) -> DataFrame:
    return index.stable_seq(t.open_trans(), LAST)


@query("a20_latest_log", "SELECT rid, nr, get_trans_seq, commit_trans_seq, mounted FROM open_trans QUALIFY row_number() OVER (PARTITION BY rid ORDER BY nr DESC) = 1", "open_trans")
def latest(t: Tables) -> DataFrame:
    return index.latest_logs(t.open_trans())


@query("a11_max_item_seq", "SELECT max(seq) AS seq FROM item_log", "item_log")
def max_seq(t: Tables) -> DataFrame:
    return t.item_log().agg(F.max("seq").alias("seq"))


@query("s05_read_xattr_index", "SELECT DISTINCT major, minor, ino FROM xattr_index WHERE major >= 5 AND (major < 20 OR major = 20 AND (minor < 150000 OR minor = 150000 AND ino <= 1000000))", "xattr_index")
def read_index(t: Tables) -> DataFrame:
    return index.read_index(t.xattr_index(), (5, 0, 0), (20, 150000, 1_000_000))


@query("a04_newest_wins", f"WITH n AS ({_NEWEST}) SELECT key, seq, is_delete, val, source FROM n WHERE NOT is_delete", "item_log")
def newest(t: Tables) -> DataFrame:
    return forest.newest(t.item_log(), ["key"])


@query("w05_newest_with_tombstones", f"WITH n AS ({_NEWEST}) SELECT key, seq, is_delete, val, source FROM n", "item_log")
def newest_all(t: Tables) -> DataFrame:
    return forest.newest(t.item_log(), ["key"], keep_deleted=True)


@query("u02_tombstoned_keys", f"WITH n AS ({_NEWEST}) SELECT key, seq FROM n WHERE is_delete", "item_log")
def tombstoned(t: Tables) -> DataFrame:
    return forest.newest(t.item_log(), ["key"], keep_deleted=True).where("is_delete").select("key", "seq")


@query("j11_snapshot", "WITH n AS (SELECT * FROM item_log WHERE seq <= 4000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, source) = 1) SELECT key, seq, is_delete, val, source FROM n WHERE NOT is_delete", "item_log")
def snapshot(t: Tables) -> DataFrame:
    return forest.snapshot(t.item_log(), ["key"], 4000)


@query(
    "a09_merge_into_base",
    """WITH b AS (SELECT * FROM item_log WHERE source = 'base' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
 l AS (SELECT * FROM item_log WHERE source = 'log' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
 j AS (SELECT coalesce(b.key, l.key) AS key, b.seq AS bs, b.val AS bv, l.seq AS ls, l.val AS lv, l.is_delete AS ld FROM (SELECT * FROM b WHERE NOT is_delete) b FULL JOIN l ON b.key = l.key),
 a AS (SELECT *, CASE WHEN ls IS NULL OR (bs IS NOT NULL AND ls <= bs) THEN 'keep' WHEN ld THEN CASE WHEN bs IS NULL THEN 'none' ELSE 'delete' END WHEN bs IS NULL THEN 'insert' ELSE 'update' END AS action FROM j)
 SELECT key, action, CASE WHEN action IN ('insert', 'update') THEN lv WHEN action = 'keep' THEN bv END AS val FROM a""",
    "item_log",
)
def merge(t: Tables) -> DataFrame:
    return forest.merge_into_base(t.item_log(), ["key"])


@query("u01_union_base_logs", "SELECT source, count(*) AS n, sum(val) AS total FROM item_log GROUP BY source", "item_log")
def union(t: Tables) -> DataFrame:
    log = t.item_log()
    return log.where("source = 'base'").unionByName(log.where("source = 'log'")).groupBy("source").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


@query("s26_point_next_prev", "SELECT what, key FROM (SELECT 'next' AS what, min(key) AS key FROM item_log WHERE key >= 77 UNION ALL SELECT 'prev', max(key) FROM item_log WHERE key <= 77 UNION ALL SELECT DISTINCT 'at', key FROM item_log WHERE key = 77) WHERE key IS NOT NULL", "item_log")
def neighbours(t: Tables) -> DataFrame:
    log = t.item_log()
    named = lambda df, what: df.select(F.lit(what).alias("what"), "key")
    return named(forest.next_key(log, "key", 77), "next").unionByName(named(forest.next_key(log, "key", 77, before=True), "prev")).unionByName(named(log.where("key = 77").select("key").distinct(), "at"))


@query("s29_next_live_key", f"WITH n AS ({_NEWEST}) SELECT min(key) AS key FROM n WHERE NOT is_delete AND key BETWEEN 30 AND 90 HAVING count(*) > 0", "item_log")
def next_live(t: Tables) -> DataFrame:
    return forest.next_key(forest.newest(t.item_log(), ["key"]).where("key <= 90"), "key", 30)


@query("s28_zero_filled_lookup", "SELECT i.ino, coalesce(s.val, 0)::BIGINT AS val FROM (SELECT ino FROM inodes) i LEFT JOIN (SELECT ino, sum(val) AS val FROM tags WHERE b = 3 GROUP BY ino) s USING (ino)", "inodes", "tags")
def zero_filled(t: Tables) -> DataFrame:
    return t.inodes().select("ino").join(t.tags().where("b = 3").groupBy("ino").agg(F.sum("val").alias("val")), "ino", "left").select("ino", F.coalesce("val", F.lit(0)).alias("val"))


def _changes(t: Tables) -> tuple[DataFrame, DataFrame]:
    log = t.item_log()
    return log.where("source = 'base'"), log.where("source = 'log' and seq % 7 = 0").groupBy("key").agg(F.max("val").alias("val"))


_BASE_NEW = "b AS (SELECT DISTINCT key FROM item_log WHERE source = 'base'), n AS (SELECT key, max(val) AS val FROM item_log WHERE source = 'log' AND seq % 7 = 0 GROUP BY key)"


@query("d01_create", f"WITH {_BASE_NEW} SELECT n.key, n.val, CASE WHEN b.key IS NULL THEN 'ok' ELSE 'exists' END AS status FROM n LEFT JOIN b ON b.key = n.key", "item_log")
def create(t: Tables) -> DataFrame:
    base, new = _changes(t)
    return forest.create(base, new, ["key"])


@query("d02_update", f"WITH {_BASE_NEW} SELECT n.key, n.val, CASE WHEN b.key IS NULL THEN 'missing' ELSE 'ok' END AS status FROM n LEFT JOIN b ON b.key = n.key", "item_log")
def update(t: Tables) -> DataFrame:
    base, new = _changes(t)
    return forest.update(base, new, ["key"])


@query("d04_delete_as_tombstone", f"WITH x AS (SELECT * FROM item_log UNION ALL SELECT key, 1000000 + key, true, NULL, 'log' FROM (SELECT DISTINCT key FROM item_log WHERE key % 3 = 0)), n AS ({_NEWEST.replace('item_log', 'x')}) SELECT key, seq, val FROM n WHERE NOT is_delete", "item_log")
def delete(t: Tables) -> DataFrame:
    log = t.item_log()
    gone = log.where("key % 3 = 0").select("key").distinct().select("key", (F.col("key") + 1_000_000).alias("seq"), F.lit(True).alias("is_delete"), F.lit(None).cast("double").alias("val"), F.lit("log").alias("source"))
    return forest.newest(log.unionByName(gone), ["key"]).select("key", "seq", "val")


@query("d06_upsert", f"WITH {_BASE_NEW}, m AS (SELECT key, max(val) AS val FROM item_log WHERE source = 'base' GROUP BY key) SELECT key, val FROM m WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, val FROM n", "item_log")
def upsert(t: Tables) -> DataFrame:
    base, new = _changes(t)
    return forest.upsert(base.groupBy("key").agg(F.max("val").alias("val")), new, ["key"])


@query("d09_index_maintenance", "WITH c AS (SELECT ino, meta_seq AS o, CASE WHEN ino % 4 = 0 THEN meta_seq + 1000000 ELSE meta_seq END AS n FROM inodes) SELECT ino, 'delete' AS op, o AS major FROM c WHERE o <> n UNION ALL SELECT ino, 'insert', n FROM c WHERE o <> n", "inodes")
def index_changes(t: Tables) -> DataFrame:
    old = t.inodes().select("ino", F.col("meta_seq").alias("major"))
    new = old.select("ino", F.when(F.col("ino") % 4 == 0, F.col("major") + 1_000_000).otherwise(F.col("major")).alias("major"))
    return forest.index_changes(old, new)


# ---- totals


def _deltas(t: Tables) -> DataFrame:
    return t.tags().select("a", "b", "c", F.col("val").alias("total"), F.lit(1).cast("long").alias("count"))


@query("a01_totl_sum", "SELECT a, b, c, sum(val)::BIGINT AS total, count(*) AS count FROM tags GROUP BY a, b, c", "tags")
def totl_sum(t: Tables) -> DataFrame:
    return totals.combine(_deltas(t)).orderBy(*totals.NAME)


@query("s06_read_totals_from", "SELECT a, b, c, sum(val)::BIGINT AS total, count(*) AS count FROM tags WHERE (a, b, c) >= (40, 5, 0) GROUP BY a, b, c", "tags")
def totals_from(t: Tables) -> DataFrame:
    return totals.combine(_deltas(t).where("a >= 40").where(index.at_least(totals.NAME, (40, 5, 0)))).orderBy(*totals.NAME)


@query("a02_setxattr_increments", "SELECT a, b, c, sum(n - o)::BIGINT AS total, 0::BIGINT AS count FROM (SELECT a, b, c, val AS o, 3 * val AS n FROM tags) GROUP BY a, b, c HAVING sum(n - o) <> 0", "tags")
def setxattr(t: Tables) -> DataFrame:
    changed = t.tags().select("a", "b", "c", F.col("val").alias("old"), (3 * F.col("val")).alias("new"))
    return totals.combine(totals.increments(changed))


@query("d08_inode_delete_reverses", "SELECT a, b, c, sum(CASE WHEN ino % 5 = 0 THEN 0 ELSE val END)::BIGINT AS total, count(*) FILTER (ino % 5 <> 0) AS count FROM tags GROUP BY a, b, c HAVING count(*) FILTER (ino % 5 <> 0) > 0", "tags")
def inode_delete(t: Tables) -> DataFrame:
    tags = t.tags()
    gone = tags.where("ino % 5 = 0").select("a", "b", "c", F.col("val").alias("old"), F.lit(None).cast("long").alias("new"))
    return totals.combine(_deltas(t).unionByName(totals.increments(gone)))


@query("d16_inject_delta", "SELECT a, b, c, sum(val)::BIGINT + 128 AS total, count(*) + 2 AS count FROM tags GROUP BY a, b, c", "tags")
def inject(t: Tables) -> DataFrame:
    own = _deltas(t)
    return totals.combine(own.unionByName(own.select("a", "b", "c").distinct().select("a", "b", "c", F.lit(128).cast("long").alias("total"), F.lit(2).cast("long").alias("count"))))


@query(
    "a03_totl_during_merge",
    """WITH g AS (SELECT a, b, c, coalesce(sum(total) FILTER (bucket = 'fs'), 0) AS ft, coalesce(sum(count) FILTER (bucket = 'fs'), 0) AS fc, coalesce(max(seq) FILTER (bucket = 'fs'), 0) AS fs,
 coalesce(sum(total) FILTER (bucket = 'input'), 0) AS it, coalesce(sum(count) FILTER (bucket = 'input'), 0) AS ic, coalesce(max(seq) FILTER (bucket = 'input'), 0) AS xs,
 coalesce(sum(total) FILTER (bucket = 'log'), 0) AS lt, coalesce(sum(count) FILTER (bucket = 'log'), 0) AS lc FROM totl_delta GROUP BY a, b, c),
 r AS (SELECT a, b, c, (CASE WHEN fs <> 0 THEN ft ELSE 0 END + CASE WHEN (fs <> 0 AND xs > fs) OR (fs = 0 AND ic > 0) THEN it ELSE 0 END + lt)::BIGINT AS total,
 (CASE WHEN fs <> 0 THEN fc ELSE 0 END + CASE WHEN (fs <> 0 AND xs > fs) OR (fs = 0 AND ic > 0) THEN ic ELSE 0 END + lc)::BIGINT AS count FROM g) SELECT * FROM r WHERE total <> 0 OR count <> 0""",
    "totl_delta",
)
def during_merge(t: Tables) -> DataFrame:
    return totals.resolve(t.totl_delta())


@query("a08_log_merge_window", "SELECT bucket, a, b, c, sum(total)::BIGINT AS total, sum(count)::BIGINT AS count FROM totl_delta WHERE bucket <> 'fs' GROUP BY ALL", "totl_delta")
def merge_window(t: Tables) -> DataFrame:
    return t.totl_delta().where("bucket <> 'fs'").groupBy("bucket", *totals.NAME).agg(F.sum("total").alias("total"), F.sum("count").alias("count"))


@query(
    "a08_merge_window_items",
    "SELECT 'item' AS kind, key AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, max(seq) AS seq, arg_max(is_delete, seq) AS is_delete, arg_max(val, seq) AS val, NULL::BIGINT AS total, NULL::BIGINT AS count FROM item_log WHERE source = 'log' AND key BETWEEN 100 AND 100000 GROUP BY key"
    " UNION ALL SELECT 'delta', a, b, c, max(seq), false, NULL, sum(total)::BIGINT, sum(count)::BIGINT FROM totl_delta WHERE bucket <> 'fs' AND a BETWEEN 100 AND 100000 GROUP BY a, b, c HAVING sum(total) <> 0 OR sum(count) <> 0",
    "item_log",
    "totl_delta",
)
def merge_window_items(t: Tables) -> DataFrame:
    """One window of keys over all logs: deltas are combined under their greatest sequence, of other items the newest stays, tombstones too."""
    items = t.item_log().where("source = 'log' and key between 100 and 100000").drop("source")
    deltas = t.totl_delta().where("bucket <> 'fs' and a between 100 and 100000")
    return forest.merge_window(items, ["key"], deltas, totals.NAME)


@query("a10_inode_count", "SELECT sum(d)::BIGINT AS inodes FROM (SELECT count(*) AS d FROM inodes UNION ALL SELECT -count(*) FROM orphans)", "inodes", "orphans")
def inode_count(t: Tables) -> DataFrame:
    base = t.inodes().agg(F.count("*").alias("d"))
    return base.unionByName(t.orphans().agg((-F.count("*")).alias("d"))).agg(F.sum("d").alias("inodes"))


# ---- search


_PRESENT = "p AS (SELECT hash, ino, id FROM srch_log GROUP BY ALL HAVING count(*) % 2 = 1)"


@query("s07_search_candidates", f"WITH {_PRESENT} SELECT DISTINCT ino FROM p WHERE hash = 4", "srch_log")
def candidates(t: Tables) -> DataFrame:
    return search.candidates(t.srch_log(), 4, 0, LAST)


@query("s08_search_end_flag", f"WITH {_PRESENT} SELECT count(*) AS tracked, count(DISTINCT ino) AS returned, count(*) = count(DISTINCT ino) AS is_end FROM p WHERE hash = 4", "srch_log")
def end_flag(t: Tables) -> DataFrame:
    """The end is told only if no object was found twice."""
    found = search.present(t.srch_log().where("hash = 4"))
    return found.agg(F.count("*").alias("tracked"), F.countDistinct("ino").alias("returned")).withColumn("is_end", F.col("tracked") == F.col("returned"))


@query("j07_search_exact", f"WITH {_PRESENT} SELECT DISTINCT ino FROM p WHERE hash = 4 AND ino IN (SELECT ino FROM xattrs WHERE name LIKE '%.4.0')", "srch_log", "xattrs")
def exact(t: Tables) -> DataFrame:
    return search.exact(search.candidates(t.srch_log(), 4, 0, LAST), t.xattrs(), ".4.0")


@query("a05_srch_parity", f"WITH {_PRESENT} SELECT hash, ino, id FROM p", "srch_log")
def parity(t: Tables) -> DataFrame:
    return search.present(t.srch_log())


@query("a06_bounded_tracking", f"WITH {_PRESENT} SELECT DISTINCT ino FROM p WHERE hash = 2 ORDER BY ino LIMIT 1000", "srch_log")
def bounded(t: Tables) -> DataFrame:
    """A pass keeps so many of the smallest: a limit is the feature."""
    return search.candidates(t.srch_log(), 2, 0, LAST, limit=1000)


@query("a07_compact", f"WITH {_PRESENT} SELECT hash, ino, id, 0::BIGINT AS run FROM p", "srch_log")
def compact(t: Tables) -> DataFrame:
    return search.compact(t.srch_log())


@query("u03_symmetric_difference", "SELECT ino FROM (SELECT DISTINCT ino FROM tags WHERE b = 1) FULL JOIN (SELECT DISTINCT ino AS j FROM tags WHERE b = 2) ON ino = j WHERE j IS NULL UNION ALL SELECT j FROM (SELECT DISTINCT ino FROM tags WHERE b = 1) FULL JOIN (SELECT DISTINCT ino AS j FROM tags WHERE b = 2) ON ino = j WHERE ino IS NULL", "tags")
def difference(t: Tables) -> DataFrame:
    return t.tags().where("b in (1, 2)").select("ino", "b").distinct().groupBy("ino").agg(F.count("*").alias("n")).where("n % 2 = 1").select("ino")


@query("o01_merge_runs", "SELECT hash, ino, id, run FROM srch_log", "srch_log")
def merge_runs(t: Tables) -> DataFrame:
    """Sorted runs, one for each range of objects, merged into one order."""
    log = t.srch_log()
    runs = [forest.sorted_runs(log.where(F.col("ino") % 3 == k), [*search.KEY, "run"]) for k in range(3)]
    return forest.merged(runs, [*search.KEY, "run"])


@query("o01_merge_whole_runs", "SELECT hash, ino, id, run FROM srch_log", "srch_log")
def merge_whole_runs(t: Tables) -> DataFrame:
    """Both runs with all their hash values."""
    log = t.srch_log()
    return log.where("run = 0").unionByName(log.where("run = 1")).orderBy("hash", "ino", "id", "run")


_PAGES = [(4, 0, 10**9, 10**6), (4, 0, 50, 10**6), (4, 2000, 10**9, 10**6), (7, 0, 10**9, 40), (7, 0, 10, 40), (99, 0, 10, 10)]


@query(
    "s08_search_pages",
    " UNION ALL ".join(
        f"SELECT {i} AS page, count(*) AS tracked, least(count(DISTINCT ino), {nr}) AS returned, (SELECT count(*) FROM (SELECT ino FROM srch_log WHERE hash = {tag} AND ino >= {first} GROUP BY hash, ino, id HAVING count(*) % 2 = 1)) <= {limit} AND count(*) = least(count(DISTINCT ino), {nr}) AS is_end FROM (SELECT ino FROM srch_log WHERE hash = {tag} AND ino >= {first} GROUP BY hash, ino, id HAVING count(*) % 2 = 1 ORDER BY ino, id LIMIT {limit})"
        for i, (tag, first, nr, limit) in enumerate(_PAGES)
    ),
    "srch_log",
)
def search_pages(t: Tables) -> DataFrame:
    """Pages of searches, of which each says whether it is the last: all was searched, and every entry tracked was returned."""
    pages = [search.page(t.srch_log(), tag, first, LAST, nr, limit).select(F.lit(i).alias("page"), "tracked", "returned", "is_end") for i, (tag, first, nr, limit) in enumerate(_PAGES)]
    return reduce(DataFrame.unionByName, pages)


_FILES = "f AS (SELECT p_partkey AS file, (1 + p_partkey * p_size % 5000) AS blocks FROM part), y AS (SELECT p_partkey AS file FROM part WHERE p_size % 10 = 0)"


@query("j13_compaction_plan", f"WITH {_FILES}, o AS (SELECT *, (length(ltrim(bin(blocks), '0')) // 2)::INT AS \"order\" FROM f WHERE file NOT IN (SELECT file FROM y)), r AS (SELECT *, row_number() OVER (PARTITION BY \"order\" ORDER BY blocks, file) AS n, count(*) OVER (PARTITION BY \"order\") AS c FROM o) SELECT file, blocks, \"order\", n::INT AS n FROM r WHERE n <= 4 AND c >= 4")
def compaction_plan(t: Tables) -> DataFrame:
    files = t.raw("part").select(F.col("p_partkey").alias("file"), (1 + F.col("p_partkey") * F.col("p_size") % 5000).alias("blocks"))
    busy = t.raw("part").where("p_size % 10 = 0").select(F.col("p_partkey").alias("file"))
    return search.plan_compaction(files, busy)


@query("j15_compaction_commit", f"WITH {_FILES} SELECT file, blocks FROM f WHERE file NOT IN (SELECT file FROM y) UNION ALL SELECT -1, sum(blocks)::BIGINT FROM f WHERE file IN (SELECT file FROM y)")
def compaction_commit(t: Tables) -> DataFrame:
    files = t.raw("part").select(F.col("p_partkey").alias("file"), (1 + F.col("p_partkey") * F.col("p_size") % 5000).alias("blocks"))
    inputs = t.raw("part").where("p_size % 10 = 0").select(F.col("p_partkey").alias("file"))
    made = files.join(inputs, "file", "left_semi").agg(F.lit(-1).cast("long").alias("file"), F.sum("blocks").alias("blocks"))
    return files.join(inputs, "file", "left_anti").unionByName(made.select("file", "blocks"))


@query("o09_compaction_order", f"WITH {_FILES} SELECT file, blocks, row_number() OVER (PARTITION BY file % 8 ORDER BY blocks, file)::INT AS n FROM f")
def compaction_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    files = t.raw("part").select(F.col("p_partkey").alias("file"), (1 + F.col("p_partkey") * F.col("p_size") % 5000).alias("blocks"))
    return files.withColumn("n", F.row_number().over(Window.partitionBy(F.col("file") % 8).orderBy("blocks", "file")))
