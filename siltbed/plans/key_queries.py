"""Keys, names and hashes; runs and logs; cursors and watermarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, parsing
from ..operators import forest, index, quota, search, totals
from ..sources.tables import Tables
from .catalog import query
from .feed_queries import LAST

_FNV_64 = "list_reduce(list_concat([14695981039346656037::HUGEINT], [ascii(x)::HUGEINT FOR x IN string_split({0}, '')]), lambda v, x: (xor(v, x) * 1099511628211) % 18446744073709551616)"


@query("p01_key_order", "SELECT ino, id, CASE WHEN (b, ino, id) < (5, 700, 2) THEN -1 WHEN (b, ino, id) = (5, 700, 2) THEN 0 ELSE 1 END AS cmp FROM tags", "tags")
def key_order(t: Tables) -> DataFrame:
    key, at = ["b", "ino", "id"], (5, 700, 2)
    low, high = index.at_least(key, at), index.at_most(key, at)
    return t.tags().select("ino", "id", F.when(~low, -1).when(low & high, 0).otherwise(1).alias("cmp"))


@query("p04_last_numbers", "SELECT ino, id, split_part(name, '.', -2)::BIGINT AS n2, split_part(name, '.', -1)::BIGINT AS n1 FROM xattrs", "xattrs")
def last_numbers(t: Tables) -> DataFrame:
    two, one = parsing.last_numbers(F.col("name"), 2)
    return t.xattrs().select("ino", "id", two.cast("long").alias("n2"), one.cast("long").alias("n1"))


@query("p08_packed_key", "SELECT lpad(hex(major), 2, '0') || lpad(hex(minor), 16, '0') || lpad(hex(ino), 16, '0') || lpad(hex(xid), 16, '0') AS packed, major, minor, ino, xid FROM xattr_index", "xattr_index")
def packed_key(t: Tables) -> DataFrame:
    names, widths = ["major", "minor", "ino", "xid"], [2, 16, 16, 16]
    packed = t.xattr_index().select(parsing.packed_key([F.col(n) for n in names], widths).alias("packed"))
    return packed.select("packed", *[c.cast("long").alias(n) for c, n in zip(parsing.unpacked_key(F.col("packed"), widths), names, strict=True)])


@query("p09_totl_names", "SELECT a || '.' || b || '.' || c AS name, count(*) AS n FROM tags GROUP BY a, b, c", "tags")
def totl_names(t: Tables) -> DataFrame:
    return t.tags().groupBy(F.struct(*totals.NAME).alias("k")).agg(F.count("*").alias("n")).select(F.concat_ws(".", "k.a", "k.b", "k.c").alias("name"), "n")


@query("p10_fnv1a_64", f"SELECT DISTINCT name, {_FNV_64.format('name')}::VARCHAR AS hash FROM dirents", "dirents")
def fnv(t: Tables) -> DataFrame:
    return t.dirents().select("name").distinct().select("name", hashing.fnv1a_64("name").cast("string").alias("hash"))


@query(
    "p11_name_hash",
    """WITH n AS (SELECT DISTINCT name, string_split(name, '') AS x FROM dirents),
 b AS (SELECT name, x, array_to_string([lpad(bin(ascii(c)), 8, '0') FOR c IN x], '') AS bits FROM n),
 f AS (SELECT name, x, rpad(array_to_string([bits[i] FOR i IN generate_series(1, length(bits), greatest(length(bits) // 32, 1))][1:32], ''), 32, '0') AS fp FROM b)
 SELECT name, (list_reduce(list_concat([0::HUGEINT], [d::HUGEINT FOR d IN string_split(fp, '')]), lambda v, d: v * 2 + d) * 4294967296
  + list_reduce(list_concat([2166136261::HUGEINT], [ascii(c)::HUGEINT FOR c IN x]), lambda v, c: (xor(v, c) * 16777619) % 4294967296))::VARCHAR AS hash FROM f""",
    "dirents",
)
def name_hash(t: Tables) -> DataFrame:
    return t.dirents().select("name").distinct().select("name", hashing.name_hash("name").cast("string").alias("hash"))


@query("p14_positions", "SELECT ino, CASE WHEN ino % 4 = 0 THEN 0 ELSE major END AS major, CASE WHEN ino % 4 IN (0, 1) THEN 0 ELSE minor END AS minor, CASE WHEN ino % 4 = 3 THEN ino WHEN ino % 4 = 0 THEN NULL ELSE 0 END AS at_ino FROM (SELECT ino, CASE WHEN ino % 4 = 0 THEN NULL ELSE major END AS major, CASE WHEN ino % 4 = 0 THEN NULL ELSE minor END AS minor FROM xattr_index) WHERE ino % 4 <> 0 UNION ALL SELECT ino, NULL, NULL, NULL FROM xattr_index WHERE ino % 4 = 0", "xattr_index")
def positions(t: Tables) -> DataFrame:
    """Written with one, two or three parts, and some that are no position."""
    part = F.col("ino") % 4
    text = F.when(part == 0, "7.x").when(part == 1, F.col("major").cast("string")).when(part == 2, F.concat_ws(".", "major", "minor")).otherwise(F.concat_ws(".", "major", "minor", "ino"))
    major, minor, ino = parsing.position(F.col("text"))
    return t.xattr_index().select("ino", text.alias("text")).select("ino", major.cast("long").alias("major"), minor.cast("long").alias("minor"), ino.cast("long").alias("at_ino"))


_NUMBERS = ["7", "+7", "-7", "0x10", "4294967295", "4294967296", "-9223372036854775808", "9223372036854775808", "1.5", "12.000000007", "3.1000000001", "x", ""]


@query(
    "p16_numbers",
    "SELECT * FROM (VALUES ('7', 7::BIGINT, 7::BIGINT, NULL::BIGINT, NULL::BIGINT), ('+7', 7, 7, NULL, NULL), ('-7', -7, NULL, NULL, NULL), ('0x10', 16, 16, NULL, NULL), ('4294967295', 4294967295, 4294967295, NULL, NULL), ('4294967296', 4294967296, NULL, NULL, NULL), ('-9223372036854775808', -9223372036854775808, NULL, NULL, NULL), ('9223372036854775808', NULL, NULL, NULL, NULL), ('1.5', NULL, NULL, 1, 5), ('12.000000007', NULL, NULL, 12, 7), ('3.1000000001', NULL, NULL, NULL, NULL), ('x', NULL, NULL, NULL, NULL), ('', NULL, NULL, NULL, NULL)) AS t(text, s64, u32, sec, nsec)",
)
def numbers(t: Tables) -> DataFrame:
    text = F.col("text")
    sec, nsec = parsing.timespec(text)
    return t.spark.createDataFrame([(x,) for x in _NUMBERS], "text string").select("text", parsing.s64(text).alias("s64"), parsing.u32(text).alias("u32"), sec.alias("sec"), nsec.alias("nsec"))


@query("s20_rule_page", f"WITH r AS (SELECT concat_ws(' ', prio, concat_ws(',', v0, s0, f0), concat_ws(',', v1, s1, f1), concat_ws(',', v2, s2, f2), op, lim, rflag) AS rule FROM quota_rules), h AS (SELECT rule, {_FNV_64.format('rule')} AS hash FROM r) SELECT rule, row_number() OVER (ORDER BY hash, rule) AS place FROM h WHERE hash > 4611686018427387904", "quota_rules")
def rule_page(t: Tables) -> DataFrame:
    """Rules, which are few, in the order of their hash, after a cursor."""
    texts = quota.to_text(t.quota_rules()).select("rule").withColumn("hash", hashing.fnv1a_64("rule"))
    return texts.where("hash > 4611686018427387904").select("rule", F.row_number().over(Window.orderBy("hash", "rule")).cast("long").alias("place"))


@query("a17_distinct_positions", "SELECT DISTINCT major, minor, ino FROM xattr_index", "xattr_index")
def distinct_positions(t: Tables) -> DataFrame:
    return t.xattr_index().select("major", "minor", "ino").distinct()


@query("w06_skip_repeats", "SELECT DISTINCT hash, ino, id FROM srch_log", "srch_log")
def skip_repeats(t: Tables) -> DataFrame:
    """The first of each run of equal entries in order."""
    before = F.lag("id").over(Window.partitionBy("hash", "ino").orderBy("id"))
    return t.srch_log().select(*search.KEY, before.alias("before")).where("before is null or before <> id").drop("before")


@query("a21_next_finalized_key", "SELECT min(key) AS key FROM item_log WHERE source = 'log' AND 1000 * (seq % 5) < 3000 AND key BETWEEN 3 AND 900 HAVING count(*) > 0", "item_log")
def next_finalized(t: Tables) -> DataFrame:
    logs = t.item_log().where("source = 'log'").withColumn("finalize_seq", 1000 * (F.col("seq") % 5))
    return index.next_finalized(logs, 3000, 3, 900)


@query("a23_finalize_decision", "WITH m AS (SELECT ino % 16 AS rid, count(*) AS items, sum(val) AS blocks FROM tags GROUP BY 1) SELECT rid, ((length(ltrim(bin(items), '0')) - 1) // 4 + 1)::BIGINT AS height, (length(ltrim(bin(items), '0')) - 1) // 4 + 1 > 2 OR blocks % 7 = 0 OR rid = 3 AS finalize FROM m", "tags")
def finalize_decision(t: Tables) -> DataFrame:
    """Trees of sixteen items to a block."""
    m = t.tags().groupBy((F.col("ino") % 16).alias("rid")).agg(F.count("*").alias("items"), F.sum("val").alias("blocks"))
    height = (F.call_function("div", F.length(F.bin("items")) - 1, F.lit(4)) + 1).cast("long")
    return index.finalize(m.select("rid", height.alias("height"), (F.col("blocks") % 7 == 0).alias("low"), (F.col("rid") == 3).alias("forced"))).select("rid", "height", "finalize")


@query("d03_delta", "SELECT a, b, c, sum(CASE WHEN ino % 2 = 0 AND b = 2 THEN 0 ELSE val END)::BIGINT AS total, count(*) FILTER (NOT (ino % 2 = 0 AND b = 2)) AS count FROM tags WHERE ino % 2 = 0 OR b = 3 GROUP BY a, b, c HAVING count(*) FILTER (NOT (ino % 2 = 0 AND b = 2)) > 0", "tags")
def delta(t: Tables) -> DataFrame:
    """Increments combine with what is there or begin a total; one that comes to nothing is erased."""
    rows = t.tags().select("ino", *totals.NAME, F.col("val").alias("total"), F.lit(1).cast("long").alias("count"))
    there, new = rows.where("ino % 2 = 0").drop("ino"), rows.where("ino % 2 = 1 and b = 3").drop("ino")
    back = there.where("b = 2").select(*totals.NAME, (-F.col("total")).alias("total"), (-F.col("count")).alias("count"))
    return totals.combine(there.unionByName(new).unionByName(back))


@query("d05_write_out", "SELECT key, seq, is_delete, val FROM item_log WHERE source = 'log'", "item_log")
def write_out(t: Tables) -> DataFrame:
    return forest.sorted_runs(t.item_log().where("source = 'log'").select("key", "seq", "is_delete", "val"), ["key", "seq"])


@query("d22_append_toggles", "WITH l AS (SELECT hash, ino, id FROM srch_log UNION ALL SELECT b, ino, id FROM tags WHERE ino % 4 = 0) SELECT hash, ino, id FROM l GROUP BY ALL HAVING count(*) % 2 = 1", "tags", "srch_log")
def append_toggles(t: Tables) -> DataFrame:
    more = t.tags().where("ino % 4 = 0").select(F.col("b").alias("hash"), "ino", "id")
    return search.present(t.srch_log().select(*search.KEY).unionByName(more))


@query("d25_volume_options", "SELECT key % 16 AS bit, max(seq) AS value FROM item_log GROUP BY 1 HAVING NOT arg_max(is_delete, seq)", "item_log")
def volume_options(t: Tables) -> DataFrame:
    changes = t.item_log().select((F.col("key") % 16).alias("bit"), "seq", F.when(F.col("is_delete"), "clear").otherwise("set").alias("op"), F.col("seq").alias("value"))
    return forest.options(changes)


@query("j10_merge_join_runs", "SELECT hash, ino, id, bool_or(run = 0) AS in_one, bool_or(run = 1) AS in_two FROM srch_log GROUP BY hash, ino, id", "srch_log")
def merge_join_runs(t: Tables) -> DataFrame:
    log = t.srch_log()
    return forest.presence({"in_one": log.where("run = 0"), "in_two": log.where("run = 1")}, search.KEY)


@query("o02_external_sort", "SELECT hash, ino, id, run FROM srch_log", "srch_log")
def external_sort(t: Tables) -> DataFrame:
    return t.srch_log().orderBy(*search.KEY, "run")


@query("o03_compact_runs", "SELECT hash, ino, id, 0::BIGINT AS run FROM srch_log GROUP BY ALL HAVING count(*) % 2 = 1", "srch_log")
def compact_runs(t: Tables) -> DataFrame:
    return forest.sorted_runs(search.compact(t.srch_log()), search.KEY)


_AT = "SELECT least({0}, coalesce(min(get_trans_seq) FILTER (get_trans_seq > commit_trans_seq AND mounted) - 1, {0}))::BIGINT AS stable_seq, {0}::BIGINT AS last_seq FROM (SELECT * FROM open_trans QUALIFY row_number() OVER (PARTITION BY rid ORDER BY nr DESC) = 1)"


@query("t01_low_watermark", " UNION ALL ".join(_AT.format(x) for x in (100, 600, LAST)), "open_trans")
def low_watermark(t: Tables) -> DataFrame:
    """The watermark at three moments: never above the last sequence given out."""
    return reduce(DataFrame.unionByName, [index.stable_seq(t.open_trans(), x).withColumn("last_seq", F.lit(x).cast("long")) for x in (100, 600, LAST)])


@query("t02_resumed_feed", "SELECT major, minor, ino, ((rn - 1) // 128)::INT AS page FROM (SELECT major, minor, ino, row_number() OVER (ORDER BY major, minor, ino) AS rn FROM seq_index WHERE index = 'data_seq') WHERE rn <= 384", "seq_index")
def resumed_feed(t: Tables) -> DataFrame:
    """Three pages of the feed; pages are the feature."""
    return index.pages(t.seq_index().where("index = 'data_seq'"), ["major", "minor", "ino"], 128, 3)


@query("t02_whole_feed", "SELECT major, minor, ino, (row_number() OVER (ORDER BY major, minor, ino) - 1) // 128 AS page FROM seq_index WHERE index = 'data_seq'", "seq_index")
def whole_feed(t: Tables) -> DataFrame:
    """The feed to its end, each row with the page that brings it."""
    return index.all_pages(t.seq_index().where("index = 'data_seq'"), ["major", "minor", "ino"], 128)
