"""Parsing, quota rules, accounting and small scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import attributes, extents, index, quota, tree
from ..sources import tables
from ..sources.tables import Tables
from .catalog import query

_PART = "CASE s{i} WHEN 'P' THEN proj WHEN 'U' THEN uid WHEN 'G' THEN gid ELSE v{i} END"
_CODE = "CASE s{i} WHEN 'L' THEN 0 WHEN 'P' THEN 1 WHEN 'U' THEN 2 ELSE 3 END"
_ORDER = "prio DESC, " + ", ".join(f"v{i} DESC, {_CODE.format(i=i)} DESC, f{i} = 'S' DESC" for i in range(3)) + ", r.op = 'D' DESC, lim DESC, rflag = 'C' DESC"
_MATCH = (
    "m AS (SELECT req, "
    + ", ".join(f"{_PART.format(i=i)} AS {n}" for i, n in enumerate("abc"))
    + ", lim, rflag, prio FROM quota_inputs q JOIN quota_rules r ON q.op = r.op AND "
    + " AND ".join(f"(f{i} <> 'S' OR {_PART.format(i=i)} = v{i})" for i in range(3))
    + f" QUALIFY row_number() OVER (PARTITION BY req ORDER BY {_ORDER}) = 1)"
)


@query("w01_top_rule", f"WITH {_MATCH} SELECT * FROM m", "quota_rules", "quota_inputs")
def top_rule(t: Tables) -> DataFrame:
    return quota.matches(t.quota_inputs(), t.quota_rules())


def _totals(t: Tables) -> DataFrame:
    i = t.inodes(sequence=False)
    names = F.array(*[F.struct(F.col(c).alias("a"), F.lit(k).cast("long").alias("b"), F.lit(0).cast("long").alias("c")) for c, k in (("uid", 1), ("uid", 2), ("proj", 3), ("gid", 4))], F.struct(*[F.lit(x).cast("long").alias(n) for n, x in (("a", 1), ("b", 1), ("c", 0))]))
    # A user's objects lie together, so they are summed first, without a shuffle.
    i = i.groupBy("uid", "proj", "gid").agg(F.sum("size").alias("size"), F.count("*").alias("n_objects"))
    return i.select("size", "n_objects", F.explode(names).alias("n")).groupBy("n.a", "n.b", "n.c").agg(F.sum("size").alias("total"), F.sum("n_objects").alias("count")).select("a", "b", "c", "total", "count")


_TOTALS = "x AS (SELECT a, b, 0 AS c, sum(size)::BIGINT AS total, count(*) AS count FROM (" + " UNION ALL ".join(f"SELECT {c} AS a, {k} AS b, size FROM inodes" for c, k in (("uid", 1), ("uid", 2), ("proj", 3), ("gid", 4), ("1", 1))) + ") GROUP BY a, b)"


@query("j03_quota_check", f"WITH {_MATCH}, {_TOTALS} SELECT q.req, coalesce(CASE WHEN m.rflag = 'C' THEN x.count ELSE x.total END >= m.lim, false) AS denied FROM quota_inputs q LEFT JOIN m ON m.req = q.req LEFT JOIN x ON x.a = m.a AND x.b = m.b AND x.c = m.c", "quota_rules", "inodes", "quota_inputs")
def quota_check(t: Tables) -> DataFrame:
    return quota.check(t.quota_inputs(), t.quota_rules(), _totals(t), tables.TASK_ROWS, lambda named: t.dealt(named, "orders", "a", "b", "c"))


@query("j02_matching_rules", "SELECT req, count(*) AS n FROM quota_inputs q JOIN quota_rules r ON q.op = r.op AND " + " AND ".join(f"(f{i} <> 'S' OR {_PART.format(i=i)} = v{i})" for i in range(3)) + " GROUP BY req", "quota_rules", "quota_inputs")
def matching(t: Tables) -> DataFrame:
    """Rules that select are looked up; those that do not match every input of their op and are only counted."""
    free = t.quota_rules().where("f0 <> 'S' and f1 <> 'S' and f2 <> 'S'").groupBy("op").agg(F.count("*").alias("n"))
    found = quota.selecting(t.quota_inputs(), t.quota_rules()).select("req", F.lit(1).cast("long").alias("n"))
    every = t.quota_inputs().join(F.broadcast(free), "op").select("req", "n")
    return found.unionByName(every).groupBy("req").agg(F.sum("n").alias("n"))


@query("w02_default_rule", f"SELECT * FROM quota_rules r WHERE 'S' NOT IN (f0, f1, f2) QUALIFY row_number() OVER (PARTITION BY op ORDER BY {_ORDER}) = 1", "quota_rules")
def default_rule(t: Tables) -> DataFrame:
    return quota.defaults(t.quota_rules()).select(*t.quota_rules().columns)


@query("o04_rule_listing", f"SELECT *, row_number() OVER (ORDER BY {_ORDER})::INT AS n FROM quota_rules r", "quota_rules")
def rule_listing(t: Tables) -> DataFrame:
    """Rules are configuration of a fixed size: one order over all of them."""
    from pyspark.sql import Window

    return t.quota_rules().withColumn("n", F.row_number().over(Window.orderBy(*[quota.code(c).desc() for c in quota.ORDER])))


@query(
    "p12_rule_validity",
    "SELECT n, rflag IN ('C', '-') AND op IN ('I', 'D') AND s0 IN ('L', 'P', 'U', 'G') AND s1 IN ('L', 'P', 'U', 'G') AND s2 IN ('L', 'P', 'U', 'G') AND NOT ('L' IN (CASE WHEN f0 = 'S' THEN s0 END, CASE WHEN f1 = 'S' THEN s1 END, CASE WHEN f2 = 'S' THEN s2 END)) IS TRUE AND f0 IN ('S', '-') AND f1 IN ('S', '-') AND f2 IN ('S', '-')"
    " AND (SELECT count(DISTINCT (s, v)) = count(DISTINCT s) FROM (VALUES (s0, f0, v0), (s1, f1, v1), (s2, f2, v2)) AS p(s, f, v) WHERE f = 'S') AS is_valid FROM rule_candidates",
    "rule_candidates",
)
def rule_validity(t: Tables) -> DataFrame:
    """Valid and invalid rules, each kind of fault among them."""
    return quota.valid(t.rule_candidates()).select("n", "is_valid")


@query("p13_rule_text", "SELECT concat_ws(' ', prio, concat_ws(',', v0, s0, f0), concat_ws(',', v1, s1, f1), concat_ws(',', v2, s2, f2), op, lim, rflag) AS rule, prio, v0, s0, f0, v1, s1, f1, v2, s2, f2, op, lim, rflag FROM quota_rules", "quota_rules")
def rule_text(t: Tables) -> DataFrame:
    return quota.from_text(quota.to_text(t.quota_rules()))


@query("d15_add_rule", "SELECT prio, lim, op, CASE WHEN prio <= 3 THEN 'exists' ELSE 'ok' END AS status FROM quota_rules", "quota_rules")
def add_rule(t: Tables) -> DataFrame:
    """Identity is all thirteen fields."""
    rules = t.quota_rules()
    known = rules.where("prio <= 3").withColumn("__known", F.lit(True))
    return rules.join(known, rules.columns, "left").select("prio", "lim", "op", F.when(F.col("__known"), "exists").otherwise("ok").alias("status"))


@query("d15_delete_rule", "SELECT * FROM quota_rules WHERE prio > 3", "quota_rules")
def delete_rule(t: Tables) -> DataFrame:
    rules = t.quota_rules()
    return rules.join(rules.where("prio <= 3"), rules.columns, "left_anti")


# ---- parsing

_TAGRUN = "regexp_extract(name, '^archive\\.(((hide|indx|srch|totl)\\.)+)', 1)"


@query("p03_tag_parse", f"SELECT {_TAGRUN} AS tags, count(*) AS n, name LIKE 'archive.%' AND {_TAGRUN} = '' AS is_invalid FROM xattrs GROUP BY ALL", "xattrs")
def tag_parse(t: Tables) -> DataFrame:
    name = F.col("name")
    return t.xattrs().groupBy(parsing.tag_run(name).alias("tags"), parsing.invalid_tags(name).alias("is_invalid")).agg(F.count("*").alias("n"))


@query("p06_totl_key", "SELECT ino, id, split_part(name, '.', -3)::BIGINT AS a, split_part(name, '.', -2)::BIGINT AS b, split_part(name, '.', -1)::BIGINT AS c FROM xattrs WHERE name LIKE '%totl.%'", "xattrs")
def totl_key(t: Tables) -> DataFrame:
    a, b, c = parsing.totl_key(F.col("name"))
    return t.xattrs().where(parsing.has_tag(F.col("name"), "totl")).select("ino", "id", a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"))


@query("p05_u64_literals", "SELECT * FROM (VALUES ('0', 0::DOUBLE), ('18446744073709551615', 18446744073709551615), ('18446744073709551616', NULL), ('0x1F', 31), ('0xfffffffffffffffff', NULL), ('017', 15), ('08', NULL), ('+1', NULL), ('-1', NULL), ('', NULL), (' 1', NULL), ('000000000000000000000000001', NULL), ('10junk', NULL)) AS t(text, value)")
def u64_literals(t: Tables) -> DataFrame:
    texts = ["0", "18446744073709551615", "18446744073709551616", "0x1F", "0xfffffffffffffffff", "017", "08", "+1", "-1", "", " 1", "0" * 26 + "1", "10junk"]
    return t.spark.createDataFrame([(x,) for x in texts], "text string").select("text", parsing.u64(F.col("text")).cast("double").alias("value"))


@query("p07_indx_key", "SELECT p_partkey, CASE WHEN p_size * 8 <= 255 AND p_partkey % 2 = 0 THEN p_size * 8 END::BIGINT AS major, CASE WHEN p_size * 8 <= 255 AND p_partkey % 2 = 0 THEN p_partkey END AS minor FROM part")
def indx_key(t: Tables) -> DataFrame:
    name = F.concat_ws(".", F.lit("archive.indx.n"), (F.col("p_size") * 8).cast("string"), F.col("p_partkey").cast("string"))
    major, minor = parsing.indx_key(name, F.when(F.col("p_partkey") % 2 == 0, "").otherwise("x"))
    return t.raw("part").select("p_partkey", major.cast("long").alias("major"), minor.cast("long").alias("minor"))


@query("p15_human_size", "SELECT * FROM (VALUES ('1', 1), ('1K', 1024), ('3M', 3145728), ('2G', 2147483648), ('1T', 1099511627776), ('5P', 5629499534213120), ('K', NULL), ('1KB', NULL), ('-1', NULL)) AS t(text, bytes)")
def human_size(t: Tables) -> DataFrame:
    texts = ["1", "1K", "3M", "2G", "1T", "5P", "K", "1KB", "-1"]
    return t.spark.createDataFrame([(x,) for x in texts], "text string").select("text", parsing.human_size(F.col("text")).alias("bytes"))


@query("p17_mode_type", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'dir' WHEN 1 THEN 'file' WHEN 2 THEN 'symlink' ELSE 'unknown' END AS type FROM part")
def mode_type(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 4
    mode = F.when(kind == 0, 0o040755).when(kind == 1, 0o100644).when(kind == 2, 0o120777).otherwise(0o000644)
    return t.raw("part").select("p_partkey", tree.mode_type(mode).alias("type"))


@query("p18_retention", "SELECT ino, (flags & 2) <> 0 AS is_blocked FROM inodes", "inodes")
def retention(t: Tables) -> DataFrame:
    return t.inodes().select("ino", (F.col("flags").bitwiseAND(2) != 0).alias("is_blocked"))


@query("p19_version_guard", "SELECT ino, CASE WHEN data_version = 3 THEN 'ok' ELSE 'stale' END AS status FROM inodes", "inodes")
def version_guard(t: Tables) -> DataFrame:
    return t.inodes().select("ino", F.when(F.col("data_version") == 3, "ok").otherwise("stale").alias("status"))


@query("p20_order_bucket", "SELECT val, CASE WHEN val < 8 THEN 0 WHEN val < 64 THEN 1 ELSE 2 END::BIGINT AS bucket, count(*) AS n FROM tags GROUP BY ALL", "tags")
def order_bucket(t: Tables) -> DataFrame:
    return t.tags().groupBy("val", extents.order_bucket(F.col("val")).alias("bucket")).agg(F.count("*").alias("n"))


@query("p21_inode_group", "SELECT ino // 1024 AS grp, bit_or(1::BIGINT << (ino % 32)::INT) AS bits, count(*) AS n FROM inodes GROUP BY 1", "inodes")
def inode_group(t: Tables) -> DataFrame:
    bit = F.expr("shiftleft(1L, cast(ino % 32 as int))")
    return t.inodes().groupBy(index.group_of(F.col("ino")).alias("grp")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


@query("p21_inode_bit", "SELECT ino, ino // 1024 AS grp, ino % 1024 AS bit FROM inodes", "inodes")
def inode_bit(t: Tables) -> DataFrame:
    """Every object with its group and its bit in the group."""
    return t.inodes().select("ino", index.group_of(F.col("ino")).alias("grp"), (F.col("ino") % 1024).alias("bit"))


@query("p22_alignment", "SELECT ino, size % 4096 = 0 AS is_aligned, (size + 4095) // 4096 AS blocks FROM inodes", "inodes")
def alignment(t: Tables) -> DataFrame:
    return t.inodes().select("ino", (F.col("size") % 4096 == 0).alias("is_aligned"), F.call_function("div", F.col("size") + 4095, F.lit(4096)).alias("blocks"))


# ---- accounting and scans


@query("s13_alloc_detail", "SELECT id, meta, avail, sum(blocks)::BIGINT AS blocks FROM alloc GROUP BY ALL", "alloc")
def alloc_detail(t: Tables) -> DataFrame:
    return t.alloc().groupBy("id", "meta", "avail").agg(F.sum("blocks").alias("blocks"))


@query("a14_df", "SELECT meta, sum(blocks)::BIGINT AS total, greatest(0, sum(blocks) FILTER (avail) - CASE WHEN meta THEN 500 ELSE 0 END)::BIGINT AS free, ((sum(blocks) - greatest(0, sum(blocks) FILTER (avail) - CASE WHEN meta THEN 500 ELSE 0 END)) * 100 // sum(blocks))::BIGINT AS used_percent FROM alloc GROUP BY meta", "alloc")
def df(t: Tables) -> DataFrame:
    sums = t.alloc().groupBy("meta").agg(F.sum("blocks").alias("total"), F.sum(F.when(F.col("avail"), F.col("blocks")).otherwise(0)).alias("avail"))
    free = F.greatest(F.lit(0), F.col("avail") - F.when(F.col("meta"), 500).otherwise(0))
    return sums.select("meta", "total", free.alias("free"), F.call_function("div", (F.col("total") - free) * 100, F.col("total")).alias("used_percent"))


@query("s19_statfs", "SELECT (SELECT sum(blocks) FROM alloc WHERE meta AND avail)::BIGINT AS free_meta, (SELECT sum(blocks) FROM alloc WHERE NOT meta AND avail)::BIGINT AS free_data, (SELECT count(*) FROM inodes) AS inodes", "alloc", "inodes")
def statfs(t: Tables) -> DataFrame:
    free = lambda meta: F.sum(F.when(F.col("avail") & (F.col("meta") == meta), F.col("blocks")).otherwise(0))
    return t.alloc().agg(free(True).alias("free_meta"), free(False).alias("free_data")).crossJoin(t.inodes().agg(F.count("*").alias("inodes")))


@query("a22_free_totals", "SELECT meta, sum(blocks)::BIGINT AS blocks FROM alloc WHERE avail GROUP BY meta", "alloc")
def free_totals(t: Tables) -> DataFrame:
    return t.alloc().where("avail").groupBy("meta").agg(F.sum("blocks").alias("blocks"))


@query("s12_data_waiting", "SELECT ino, iblock, bit_or(op) AS op FROM waiters WHERE (ino, iblock) > (20, 3) GROUP BY ALL", "waiters")
def data_waiting(t: Tables) -> DataFrame:
    """After an exclusive cursor."""
    return t.waiters().where(index.at_least(["ino", "iblock"], (20, 4))).groupBy("ino", "iblock").agg(F.bit_or("op").alias("op"))


@query("d17_wait_error", "SELECT ino, count(*) AS woken FROM waiters WHERE iblock BETWEEN 2 AND 5 AND (op & 3) <> 0 GROUP BY ino", "waiters")
def wait_error(t: Tables) -> DataFrame:
    return t.waiters().where(F.col("iblock").between(2, 5) & (F.col("op").bitwiseAND(3) != 0)).groupBy("ino").agg(F.count("*").alias("woken"))


@query("j08_orphans", "SELECT ino FROM orphans WHERE ino NOT IN (SELECT ino FROM open_inos)", "orphans", "open_inos")
def orphans(t: Tables) -> DataFrame:
    return t.orphans().join(t.open_inos(), "ino", "left_anti")


@query("j09_open_map", "SELECT ino // 1024 AS grp, count(DISTINCT ino) AS n_open FROM mounts GROUP BY 1", "mounts")
def open_map(t: Tables) -> DataFrame:
    return t.mounts().select("ino").distinct().groupBy(index.group_of(F.col("ino")).alias("grp")).agg(F.count("*").alias("n_open"))


@query("s09_allocated_inos", "SELECT DISTINCT ino FROM inodes WHERE ino BETWEEN 1500 AND 2047", "inodes")
def allocated(t: Tables) -> DataFrame:
    return index.allocated(t.inodes(), 1500)


@query("s16_listxattr", "SELECT ino, name FROM xattrs WHERE name NOT LIKE '%hide.%'", "xattrs")
def listxattr(t: Tables) -> DataFrame:
    return t.xattrs().where(~parsing.has_tag(F.col("name"), "hide")).select("ino", "name")


@query("s16_listxattr_hidden", "SELECT ino, name FROM xattrs WHERE name LIKE 'archive.hide.%'", "xattrs")
def listxattr_hidden(t: Tables) -> DataFrame:
    return t.xattrs().where(parsing.has_tag(F.col("name"), "hide")).select("ino", "name")


@query("d07_setxattr_logs", "SELECT ino, id, name LIKE '%totl.%' AS to_totals, name LIKE '%srch.%' AS to_search, name LIKE '%indx.%' AS to_index FROM xattrs", "xattrs")
def setxattr_logs(t: Tables) -> DataFrame:
    name = F.col("name")
    return t.xattrs().select("ino", "id", *[parsing.has_tag(name, tag).alias(out) for tag, out in (("totl", "to_totals"), ("srch", "to_search"), ("indx", "to_index"))])


@query("s17_stat_more", "SELECT ino, size, meta_seq, data_version FROM inodes WHERE nlink > 0", "inodes")
def stat_more(t: Tables) -> DataFrame:
    """One mask for all objects."""
    asked = sum(attributes.MASK[c] for c in ("size", "meta_seq", "data_version"))
    return attributes.columns_of(t.inodes().where("nlink > 0"), asked)


@query(
    "s17_attributes_by_mask",
    "WITH o AS (SELECT ino, (coalesce(sum(len) FILTER (map <> 0 AND flags & 2 = 0), 0))::BIGINT AS on_, (coalesce(sum(len) FILTER (NOT (map <> 0 AND flags & 2 = 0) AND flags & 1 <> 0), 0))::BIGINT AS off FROM mapped GROUP BY ino), c AS (SELECT *, ino * 37 % 1024 AS m FROM inodes LEFT JOIN o USING (ino)) SELECT ino, "
    + ", ".join(f"CASE WHEN m & {bit} <> 0 THEN {c} END AS {n}" for n, bit, c in (("meta_seq", 1, "meta_seq"), ("data_seq", 2, "CASE WHEN NOT is_dir THEN meta_seq END"), ("data_version", 4, "data_version"), ("online_blocks", 8, "coalesce(on_, 0)"), ("offline_blocks", 16, "coalesce(off, 0)"), ("size", 128, "size"), ("retention", 256, "flags & 2 <> 0"), ("project", 512, "proj")))
    + " FROM c",
    "inodes",
    "mapped",
)
def attributes_by_mask(t: Tables) -> DataFrame:
    """Every object with a mask of its own; attributes that were not asked for are null."""
    blocks = extents.on_off(t.mapped()).select("ino", F.col("online").alias("online_blocks"), F.col("offline").alias("offline_blocks"))
    data_seq = F.when(~F.col("is_dir"), F.col("meta_seq"))
    known = t.inodes().select("ino", "meta_seq", data_seq.alias("data_seq"), "data_version", "size", (F.col("flags").bitwiseAND(2) != 0).alias("retention"), F.col("proj").alias("project"))
    known = known.join(blocks, "ino", "left").na.fill(0, ["online_blocks", "offline_blocks"])
    return attributes.chosen(known, t.inodes().select("ino", (F.col("ino") * 37 % 1024).alias("mask")))


@query("s32_counters", "SELECT event_type AS name, count(*) AS value FROM events GROUP BY 1")
def counters(t: Tables) -> DataFrame:
    return t.raw("events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value")).orderBy("name")


_ASKED = "mask <> 0 AND NOT ((mask & 4 <> 0 AND new_version = 0) OR (mask & 132 <> 0 AND (is_dir OR data_version <> 0)) OR (mask & 128 <> 0 AND new_size > 0 AND (mask & 4 = 0 OR new_version = 0)) OR (change_flags & 1 <> 0 AND (mask & 128 = 0 OR new_size = 0)) OR (mask & 256 <> 0 AND is_dir))"
_STATUS = f"CASE WHEN mask = 0 THEN 'none' WHEN NOT ({_ASKED}) THEN 'invalid' WHEN flags & 2 <> 0 AND NOT (mask & 256 <> 0 AND bits & 1 = 0) THEN 'retained' ELSE 'ok' END"


@query("d14_setattr_validation", f"SELECT ino, {_STATUS} AS status FROM fresh_inodes JOIN attr_changes USING (ino)", "fresh_inodes", "attr_changes")
def setattr_validation(t: Tables) -> DataFrame:
    """Whether a change may be made: the interface's rules, then retention."""
    return t.fresh_inodes().join(t.attr_changes(), "ino").select("ino", attributes.status().alias("status"))


@query(
    "d24_all_or_nothing",
    f"WITH s AS (SELECT *, {_STATUS} AS status FROM fresh_inodes JOIN attr_changes USING (ino)) SELECT ino, status, CASE WHEN status = 'ok' AND mask & 4 <> 0 THEN new_version ELSE data_version END AS data_version, CASE WHEN status = 'ok' AND mask & 128 <> 0 THEN new_size ELSE size END AS size,"
    " CASE WHEN status = 'ok' AND mask & 256 <> 0 THEN (flags & ~2) | CASE WHEN bits & 1 <> 0 THEN 2 ELSE 0 END ELSE flags END AS flags, CASE WHEN status = 'ok' AND mask & 512 <> 0 THEN new_proj ELSE proj END AS proj, (CASE WHEN status = 'ok' AND change_flags & 1 <> 0 THEN (new_size + 4095) // 4096 ELSE 0 END)::BIGINT AS offline_made FROM s",
    "fresh_inodes",
    "attr_changes",
)
def all_or_nothing(t: Tables) -> DataFrame:
    """A change is made whole or not at all; retention stops all but the change that ends it."""
    return attributes.change(t.fresh_inodes(), t.attr_changes())
