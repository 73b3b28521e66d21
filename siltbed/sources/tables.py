"""Archive-metadata tables derived from the test tables, as DataFrames and as SQL.

Row numbers are never taken over a whole table in one task: a sequence is an
offset for each date plus a rank within the date, an identity is a rank within
the object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .scratch import written

#: Rows of a large table that one task gets where it must hold them, and the rows from which a table is large.
TASK_ROWS, LARGE_ROWS = 1 << 18, 1 << 20
#: Tasks to deal to up to which a shuffle writes each row at once (spark.shuffle.sort.bypassMergeThreshold); for more it first holds a writing task's rows.
AT_ONCE = 200


class Tables:
    """Derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._rows: dict[str, int] = {}
        self._objects: DataFrame | None = None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """``df``, which grows with the table ``name``, dealt by its keys to tasks of about TASK_ROWS of that table's rows.

        Left to itself Spark puts small partitions together until each core has one, so that a task's windows, sorts
        and groups grow with the table. What is dealt by the same table meets in joins without another shuffle.
        """
        tasks = self._tasks(name)
        return df.repartition(tasks, *keys) if tasks else df

    def _tasks(self, name: str) -> int:
        """How many tasks the table is dealt to; 0 if it is not large."""
        if name not in self._rows:
            self._rows[name] = self.raw(name).count()  # from the footers
        rows = self._rows[name]
        return max(-(-rows // TASK_ROWS), int(self.spark.conf.get("spark.sql.shuffle.partitions"))) if rows > LARGE_ROWS else 0

    def spread(self, name: str, *keys: str) -> DataFrame:
        """The table as it is read, for columns that are then dealt.

        How many rows a split has depends on how well the file is packed. Where they are dealt to so many tasks that Spark would hold
        a split's rows, they go by AT_ONCE tasks first. What is dealt must have a computed key, as Spark drops a deal that another follows.
        """
        return self.raw(name).repartition(AT_ONCE, *keys) if self._tasks(name) > AT_ONCE else self.raw(name)

    def by_lines(self, df: DataFrame, *keys: str) -> DataFrame:
        return self.dealt(df, "lineitem", *keys)

    def inodes(self, sequence: bool = True) -> DataFrame:
        """``sequence``: with meta_seq, which takes a shuffle by date; others go without."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        if sequence:
            orders = self.dealt(orders, "orders", "o_orderdate")
            days = orders.groupBy("o_orderdate").agg(F.count("*").alias("n"))
            before = days.withColumn("before", F.sum("n").over(Window.orderBy("o_orderdate").rowsBetween(Window.unboundedPreceding, -1))).select("o_orderdate", F.coalesce("before", F.lit(0)).alias("before"))
            rank = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
            # One row for each date is broadcast.
            orders = orders.withColumn("rank", rank).join(F.broadcast(before), "o_orderdate").withColumn("meta_seq", (F.col("before") + F.col("rank")).cast("long"))
        customer = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        rows = self.dealt(orders, "orders", "o_custkey").join(customer, "o_custkey")
        key = F.col("o_orderkey")
        return rows.select(
            (key + 1).alias("ino"),
            F.floor("o_totalprice").cast("long").alias("size"),
            *(["meta_seq"] if sequence else []),
            (1 + key % 5).alias("data_version"),
            F.col("o_custkey").alias("uid"),
            (F.col("c_nationkey") + 1).cast("long").alias("gid"),
            (F.col("o_custkey") % 8).alias("proj"),
            (key % 10 == 0).alias("is_dir"),
            F.when(key % 97 == 0, 0).otherwise(1).cast("long").alias("nlink"),
            (key % 4).alias("flags"),
        )

    def objects(self) -> DataFrame:
        """What moves need of the objects, written once."""
        if self._objects is None:
            self._objects = written(self.inodes(sequence=False).select("ino", "size", "data_version", "is_dir", "flags"))
        return self._objects

    def seq_index(self) -> DataFrame:
        """Directories have no data_seq row."""
        inodes = self.inodes().select("ino", "meta_seq", "is_dir")
        kinds = F.when(F.col("is_dir"), F.array(F.lit("meta_seq"))).otherwise(F.array(F.lit("meta_seq"), F.lit("data_seq")))
        return inodes.select(F.explode(kinds).alias("index"), F.col("meta_seq").alias("major"), F.lit(0).cast("long").alias("minor"), "ino")

    def open_trans(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            (key % 16).alias("rid"), F.call_function("div", key, F.lit(16)).alias("nr"), (500 + 37 * key).alias("get_trans_seq"), (500 + 37 * key - key % 3).alias("commit_trans_seq"), (key % 5 != 0).alias("mounted")
        )

    def item_log(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_delete"), F.col("value").alias("val"), F.when(F.col("event_id") % 4 == 0, "base").otherwise("log").alias("source"))

    def _lines(self, dealt: bool) -> tuple[DataFrame, WindowSpec]:
        """Lines with the object they belong to, and the order of an object's lines."""
        lines = (self.spread("lineitem", "l_orderkey") if dealt else self.raw("lineitem")).withColumn("ino", F.col("l_orderkey") + 1)
        order = Window.partitionBy("ino").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        return self.dealt(lines, "lineitem", "ino") if dealt else lines, order

    def tags(self, dealt: bool = False) -> DataFrame:
        """``dealt``: for queries that go on by object; others drop the window if they need no id."""
        lines, order = self._lines(dealt)
        return lines.select(
            "ino",
            F.row_number().over(order).cast("long").alias("id"),
            (F.col("l_suppkey") + 1).alias("a"),
            (F.col("l_partkey") % 10).alias("b"),
            F.lit(0).cast("long").alias("c"),
            F.col("l_quantity").cast("long").alias("val"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
        )

    def xattrs(self) -> DataFrame:
        """Tag names as an archive agent writes them, some hidden, some searchable, some neither."""
        t = self.tags()
        kind = F.when(F.col("id") % 4 == 0, "hide.totl.").when(F.col("id") % 4 == 1, "totl.").when(F.col("id") % 4 == 2, "hide.srch.").otherwise("")
        name = F.concat(F.when(kind != "", F.concat(F.lit("archive."), kind)).otherwise("user."), F.concat_ws(".", F.lit("k"), "a", "b", "c"))
        return t.select("ino", "id", name.alias("name"), F.col("val").cast("string").alias("value"))

    def totl_delta(self) -> DataFrame:
        """Contributions in three places: the merged base, logs under merge and newer logs."""
        t = self.tags()
        bucket = F.when(F.col("id") % 3 == 0, "fs").when(F.col("id") % 3 == 1, "input").otherwise("log")
        return t.select("a", "b", "c", F.col("val").alias("total"), F.lit(1).cast("long").alias("count"), (F.col("ino") % 1000 + F.when(bucket == "input", 3).otherwise(0)).alias("seq"), bucket.alias("bucket"))

    def srch_log(self) -> DataFrame:
        t = self.tags().select(F.col("b").alias("hash"), "ino", "id", "flag")
        times = F.when(F.col("flag") == "R", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).cast("array<long>")
        return t.select("hash", "ino", "id", F.explode(times).alias("run"))

    def xattr_index(self) -> DataFrame:
        return self.raw("part").select(F.col("p_size").cast("long").alias("major"), F.round(F.col("p_retailprice") * 100).cast("long").alias("minor"), (F.col("p_partkey") + 1).alias("ino"), (F.col("p_partkey") % 3).alias("xid"))

    def dirents(self) -> DataFrame:
        """A heap-shaped tree: the root is 1, an object's parent is half its number."""
        ino = F.col("p_partkey") + 1
        return self.raw("part").where("p_partkey > 0").select(F.call_function("div", ino, F.lit(2)).alias("dir_ino"), (2 + ino % 2).alias("pos"), ino.alias("ino"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 7 == 0, "dir").otherwise("file").alias("type"))

    def links(self) -> DataFrame:
        """The tree with second and third links of files, in directories two and three levels up."""
        d = self.dirents()
        files = d.join(d.select(F.col("dir_ino").alias("ino")).distinct(), "ino", "left_anti")
        more = lambda k: files.where(F.col("ino") % (k + 1) == 0).select(F.call_function("div", "ino", F.lit(2**k)).alias("dir_ino"), (F.col("ino") + 10 * k).alias("pos"), "ino", F.concat("name", F.lit(f".{k}")).alias("name"), "type")
        return d.unionByName(more(2)).unionByName(more(3))

    def extents(self) -> DataFrame:
        lines, order = self._lines(True)
        length = F.col("l_quantity").cast("long")
        before = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return lines.select("ino", before.alias("start"), length.alias("len"), F.lit(0).cast("long").alias("map"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long").alias("flags"))

    def mapped(self) -> DataFrame:
        """Extents of which those not offline are stored at consecutive blocks; some are unwritten."""
        e = self.extents()
        return e.select("ino", "start", "len", F.when(F.col("flags") == 1, 0).otherwise(1000 + F.col("start")).cast("long").alias("map"), F.when(F.col("flags") == 1, 1).when(F.col("len") % 5 == 0, 2).otherwise(0).cast("long").alias("flags"))

    def releases(self) -> DataFrame:
        """Some of all blocks, some of the first half, some with a stale version or odd bytes."""
        ino = F.col("ino")
        length = F.when(ino % 4 == 0, 400 * 4096).when(ino % 4 == 1, 20 * 4096).when(ino % 4 == 2, 40 * 4096).otherwise(20 * 4096 + ino % 2)
        return self.inodes().select("ino", (ino % 2 * 8192).alias("offset"), length.cast("long").alias("length"), F.when(ino % 5 == 0, 9).otherwise(F.col("data_version")).cast("long").alias("version"))

    def stages(self) -> DataFrame:
        """Ranges inside and outside the size, to its odd end, and some with a stale version."""
        ino, size = F.col("ino"), F.col("size")
        offset = ino % 3 * 4096 + F.when(ino % 29 == 0, 1).otherwise(0)
        length = F.when(ino % 4 == 0, size - offset).when(ino % 4 == 1, 10 * 4096).when(ino % 4 == 2, 0).otherwise(10 * 4096 + 1)
        return self.inodes().select("ino", offset.cast("long").alias("offset"), length.cast("long").alias("length"), F.when(ino % 11 == 0, 9).otherwise(F.col("data_version")).cast("long").alias("version"), F.lit(900_000).cast("long").alias("to_map"))

    def move_targets(self) -> DataFrame:
        """The objects and for each a target: every third is full of offline blocks, some are retained or directories."""
        ino, size = F.col("ino"), F.col("size")
        old = self.objects().select("ino", "size", "data_version", "is_dir", "flags")
        new = old.select((ino + 5_000_000).alias("ino"), size, F.lit(1).cast("long").alias("data_version"), (ino % 17 == 0).alias("is_dir"), F.when(ino % 13 == 0, 2).otherwise(0).cast("long").alias("flags"))
        return old.unionByName(new)

    def move_extents(self) -> DataFrame:
        """Stored blocks without offline ones for most objects, and the targets' offline blocks."""
        ino = F.col("ino")
        own = self.mapped().where("ino % 9 = 0 or flags <> 1")
        full = self.objects().where(ino % 3 == 0).select((ino + 5_000_000).alias("ino"), F.lit(0).cast("long").alias("start"), F.when(ino % 2 == 0, 500).otherwise(30).cast("long").alias("len"), F.lit(0).cast("long").alias("map"), F.lit(1).cast("long").alias("flags"))
        some = self.objects().where(ino % 10 == 1).select((ino + 5_000_000).alias("ino"), F.lit(600).cast("long").alias("start"), F.lit(5).cast("long").alias("len"), F.lit(77).cast("long").alias("map"), F.lit(0).cast("long").alias("flags"))
        near = self.objects().where(ino % 10 == 2).select((ino + 5_000_000).alias("ino"), F.lit(10).cast("long").alias("start"), F.lit(5).cast("long").alias("len"), F.lit(77).cast("long").alias("map"), F.lit(0).cast("long").alias("flags"))
        return own.unionByName(full).unionByName(some).unionByName(near.where("(ino - 5000000) % 3 <> 0"))

    def moves(self) -> DataFrame:
        ino, size = F.col("ino"), F.col("size")
        from_off = ino % 3 * 4096 + F.when(ino % 31 == 0, 1).otherwise(0) + F.when(ino % 37 == 0, 4096 * 500).otherwise(0)
        length = F.when(ino % 5 == 0, size - from_off).otherwise(20 * 4096)
        return self.objects().select("ino", (ino + 5_000_000).alias("to_ino"), from_off.cast("long").alias("from_off"), length.cast("long").alias("length"), F.lit(8192).cast("long").alias("to_off"), (ino % 3 == 0).alias("is_stage"), F.when(ino % 19 == 0, 2).otherwise(1).cast("long").alias("version"))

    def waiters(self) -> DataFrame:
        op = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(4)
        return self.raw("events").select(F.col("user_id").alias("ino"), (F.col("event_id") % 16).alias("iblock"), op.cast("long").alias("op"))

    def orphans(self) -> DataFrame:
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
        return self.raw("orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti").select((F.col("o_orderkey") + 1).alias("ino"))

    def open_inos(self) -> DataFrame:
        return self.raw("events").where("event_id % 5 = 0").select((F.col("event_id") + 1).alias("ino")).distinct()

    def alloc(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select((key % 12).alias("id"), (key % 3 == 0).alias("meta"), (key % 2 == 0).alias("avail"), F.col("p_size").cast("long").alias("blocks"))

    def quota_rules(self) -> DataFrame:
        names = "prio long, v0 long, s0 string, f0 string, v1 long, s1 string, f1 string, v2 long, s2 string, f2 string, op string, lim long, rflag string"
        return self.spark.createDataFrame(QUOTA_RULES, names)

    def quota_inputs(self) -> DataFrame:
        return self.inodes(sequence=False).select(F.col("ino").alias("req"), "proj", "uid", "gid", F.when(F.col("ino") % 2 == 0, "I").otherwise("D").alias("op"))

    def rule_candidates(self) -> DataFrame:
        names = "prio long, v0 long, s0 string, f0 string, v1 long, s1 string, f1 string, v2 long, s2 string, f2 string, op string, lim long, rflag string, n long"
        return self.spark.createDataFrame([(*r, i) for i, r in enumerate(QUOTA_RULES + FAULTY_RULES)], names)

    def fresh_inodes(self) -> DataFrame:
        """Objects of which a third have no data yet (version 0)."""
        return self.inodes().withColumn("data_version", F.when(F.col("ino") % 3 == 0, 0).otherwise(F.col("data_version")).cast("long"))

    def attr_changes(self) -> DataFrame:
        ino = F.col("ino")
        half = lambda n: F.call_function("div", ino, F.lit(n)) % 2
        # Mostly few bits at a time, as a change with all of them is seldom valid.
        mask = F.when(ino % 7 == 0, 132).when(ino % 7 == 1, 256).when(ino % 7 == 2, 512).when(ino % 7 == 3, 4).otherwise(ino * 37 % 1024)
        return self.inodes().select("ino", mask.cast("long").alias("mask"), half(9).alias("change_flags"), (half(5) * 5000).alias("new_size"), (ino % 4).alias("new_version"), half(11).alias("bits"), F.lit(9).cast("long").alias("new_proj"))

    def mounts(self) -> DataFrame:
        """Which objects each mount holds open, in groups of 1024."""
        return self.raw("events").select((F.col("user_id") % 5).alias("rid"), (F.col("event_id") + 1).alias("ino"))


#: prio, three of (value, source, flag), op, limit, rule flag.
QUOTA_RULES = [
    (1, 1, "L", "-", 1, "L", "-", 0, "L", "-", "I", 1000000, "-"),
    (1, 1, "L", "-", 1, "L", "-", 0, "L", "-", "D", 1000000, "C"),
    (2, 5, "U", "S", 1, "L", "-", 0, "L", "-", "I", 10, "-"),
    (2, 7, "U", "S", 2, "L", "-", 0, "L", "-", "D", 5000, "-"),
    (3, 3, "P", "S", 3, "L", "-", 0, "L", "-", "I", 300, "C"),
    (3, 4, "P", "S", 9, "G", "S", 0, "L", "-", "I", 200, "-"),
    (4, 12, "G", "S", 4, "L", "-", 0, "L", "-", "D", 700, "-"),
    (4, 6, "P", "-", 5, "L", "-", 0, "L", "-", "D", 20, "C"),
    (5, 11, "U", "-", 6, "L", "-", 0, "L", "-", "I", 900, "-"),
    (5, 2, "P", "S", 7, "G", "S", 0, "L", "-", "D", 100, "-"),
    (6, 9, "U", "S", 3, "G", "S", 0, "L", "-", "I", 0, "C"),
    (6, 20, "G", "S", 8, "L", "-", 0, "L", "-", "I", 1500, "-"),
]

#: A fault each: op, flag, source, a literal that selects, one attribute selected with two values (three ways); then two valid ones.
FAULTY_RULES = [
    (1, 1, "L", "-", 1, "L", "-", 0, "L", "-", "X", 1, "-"),
    (1, 1, "L", "-", 1, "L", "-", 0, "L", "-", "I", 1, "x"),
    (1, 1, "Z", "-", 1, "L", "-", 0, "L", "-", "I", 1, "-"),
    (1, 1, "L", "S", 1, "L", "-", 0, "L", "-", "I", 1, "-"),
    (1, 1, "U", "S", 2, "U", "S", 0, "L", "-", "I", 1, "-"),
    (1, 1, "G", "S", 2, "L", "-", 3, "G", "S", "D", 1, "-"),
    (1, 1, "L", "-", 2, "P", "S", 3, "P", "S", "D", 1, "C"),
    (1, 5, "U", "S", 5, "U", "S", 5, "U", "S", "I", 1, "-"),
    (1, 5, "U", "S", 6, "U", "-", 7, "G", "S", "D", 1, "-"),
]

_RULE_ROWS = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in QUOTA_RULES)

_CANDIDATES = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in (*r, i)) + ")" for i, r in enumerate(QUOTA_RULES + FAULTY_RULES))

SQL = {
    "inodes": """SELECT o_orderkey + 1 AS ino, floor(o_totalprice)::BIGINT AS size, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS meta_seq, 1 + o_orderkey % 5 AS data_version,
  o_custkey AS uid, (c_nationkey + 1)::BIGINT AS gid, o_custkey % 8 AS proj, o_orderkey % 10 = 0 AS is_dir, (CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 1 END)::BIGINT AS nlink, o_orderkey % 4 AS flags
  FROM orders JOIN customer ON c_custkey = o_custkey""",
    "seq_index": "SELECT 'meta_seq' AS index, meta_seq AS major, 0::BIGINT AS minor, ino FROM inodes UNION ALL SELECT 'data_seq', meta_seq, 0, ino FROM inodes WHERE NOT is_dir",
    "open_trans": "SELECT s_suppkey % 16 AS rid, s_suppkey // 16 AS nr, 500 + 37 * s_suppkey AS get_trans_seq, 500 + 37 * s_suppkey - s_suppkey % 3 AS commit_trans_seq, s_suppkey % 5 <> 0 AS mounted FROM supplier",
    "item_log": "SELECT user_id AS key, event_id AS seq, event_type = 'error' AS is_delete, value AS val, CASE WHEN event_id % 4 = 0 THEN 'base' ELSE 'log' END AS source FROM events",
    "tags": """SELECT l_orderkey + 1 AS ino, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id,
  l_suppkey + 1 AS a, l_partkey % 10 AS b, 0::BIGINT AS c, l_quantity::BIGINT AS val, l_returnflag AS flag, l_linestatus AS status FROM lineitem""",
    "xattrs": """SELECT ino, id, CASE id % 4 WHEN 0 THEN 'archive.hide.totl.' WHEN 1 THEN 'archive.totl.' WHEN 2 THEN 'archive.hide.srch.' ELSE 'user.' END || 'k.' || a || '.' || b || '.' || c AS name, val::VARCHAR AS value FROM tags""",
    "totl_delta": """SELECT a, b, c, val AS total, 1::BIGINT AS count, ino % 1000 + CASE WHEN id % 3 = 1 THEN 3 ELSE 0 END AS seq, CASE id % 3 WHEN 0 THEN 'fs' WHEN 1 THEN 'input' ELSE 'log' END AS bucket FROM tags""",
    "srch_log": "SELECT b AS hash, ino, id, 0::BIGINT AS run FROM tags UNION ALL SELECT b, ino, id, 1 FROM tags WHERE flag = 'R'",
    "xattr_index": "SELECT p_size::BIGINT AS major, round(p_retailprice * 100)::BIGINT AS minor, p_partkey + 1 AS ino, p_partkey % 3 AS xid FROM part",
    "dirents": "SELECT (p_partkey + 1) // 2 AS dir_ino, 2 + (p_partkey + 1) % 2 AS pos, p_partkey + 1 AS ino, p_name || '-' || p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN 'dir' ELSE 'file' END AS type FROM part WHERE p_partkey > 0",
    "links": "SELECT dir_ino, pos, ino, name, type FROM dirents"
    + "".join(f" UNION ALL SELECT ino // {2**k}, ino + {10 * k}, ino, name || '.{k}', type FROM dirents WHERE ino % {k + 1} = 0 AND ino NOT IN (SELECT dir_ino FROM dirents)" for k in (2, 3)),
    "extents": "SELECT ino, (sum(val) OVER (PARTITION BY ino ORDER BY id) - val)::BIGINT AS start, val AS len, 0::BIGINT AS map, (CASE WHEN flag = 'R' THEN 1 ELSE 0 END)::BIGINT AS flags FROM tags",
    "mapped": "SELECT ino, start, len, (CASE WHEN flags = 1 THEN 0 ELSE 1000 + start END)::BIGINT AS map, (CASE WHEN flags = 1 THEN 1 WHEN len % 5 = 0 THEN 2 ELSE 0 END)::BIGINT AS flags FROM extents",
    "releases": "SELECT ino, ino % 2 * 8192 AS \"offset\", CASE ino % 4 WHEN 0 THEN 400 * 4096 WHEN 1 THEN 20 * 4096 WHEN 2 THEN 40 * 4096 ELSE 20 * 4096 + ino % 2 END AS length, CASE WHEN ino % 5 = 0 THEN 9 ELSE data_version END AS version FROM inodes",
    "stages": "SELECT ino, o AS \"offset\", CASE ino % 4 WHEN 0 THEN size - o WHEN 1 THEN 40960 WHEN 2 THEN 0 ELSE 40961 END AS length, CASE WHEN ino % 11 = 0 THEN 9 ELSE data_version END AS version FROM (SELECT *, ino % 3 * 4096 + CASE WHEN ino % 29 = 0 THEN 1 ELSE 0 END AS o FROM inodes)",
    "move_targets": "SELECT ino, size, data_version, is_dir, flags FROM inodes UNION ALL SELECT ino + 5000000, size, 1, ino % 17 = 0, CASE WHEN ino % 13 = 0 THEN 2 ELSE 0 END FROM inodes",
    "move_extents": "SELECT ino, start, len, map, flags FROM mapped WHERE ino % 9 = 0 OR flags <> 1 UNION ALL SELECT ino + 5000000, 0, CASE WHEN ino % 2 = 0 THEN 500 ELSE 30 END, 0, 1 FROM inodes WHERE ino % 3 = 0 UNION ALL SELECT ino + 5000000, 600, 5, 77, 0 FROM inodes WHERE ino % 10 = 1 UNION ALL SELECT ino + 5000000, 10, 5, 77, 0 FROM inodes WHERE ino % 10 = 2 AND ino % 3 <> 0",
    "moves": "SELECT ino, ino + 5000000 AS to_ino, o AS from_off, CASE WHEN ino % 5 = 0 THEN size - o ELSE 81920 END AS length, 8192::BIGINT AS to_off, ino % 3 = 0 AS is_stage, CASE WHEN ino % 19 = 0 THEN 2 ELSE 1 END AS version FROM (SELECT *, ino % 3 * 4096 + CASE WHEN ino % 31 = 0 THEN 1 ELSE 0 END + CASE WHEN ino % 37 = 0 THEN 4096 * 500 ELSE 0 END AS o FROM inodes)",
    "waiters": "SELECT user_id AS ino, event_id % 16 AS iblock, (CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 4 END)::BIGINT AS op FROM events",
    "orphans": "SELECT o_orderkey + 1 AS ino FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "open_inos": "SELECT DISTINCT event_id + 1 AS ino FROM events WHERE event_id % 5 = 0",
    "alloc": "SELECT p_partkey % 12 AS id, p_partkey % 3 = 0 AS meta, p_partkey % 2 = 0 AS avail, p_size::BIGINT AS blocks FROM part",
    "quota_rules": f"SELECT prio::BIGINT AS prio, v0::BIGINT AS v0, s0, f0, v1::BIGINT AS v1, s1, f1, v2::BIGINT AS v2, s2, f2, op, lim::BIGINT AS lim, rflag FROM (VALUES {_RULE_ROWS}) AS t(prio, v0, s0, f0, v1, s1, f1, v2, s2, f2, op, lim, rflag)",
    "rule_candidates": f"SELECT prio::BIGINT AS prio, v0::BIGINT AS v0, s0, f0, v1::BIGINT AS v1, s1, f1, v2::BIGINT AS v2, s2, f2, op, lim::BIGINT AS lim, rflag, n::BIGINT AS n FROM (VALUES {_CANDIDATES}) AS t(prio, v0, s0, f0, v1, s1, f1, v2, s2, f2, op, lim, rflag, n)",
    "fresh_inodes": "SELECT * REPLACE (CASE WHEN ino % 3 = 0 THEN 0 ELSE data_version END AS data_version) FROM inodes",
    "attr_changes": "SELECT ino, CASE ino % 7 WHEN 0 THEN 132 WHEN 1 THEN 256 WHEN 2 THEN 512 WHEN 3 THEN 4 ELSE ino * 37 % 1024 END AS mask, ino // 9 % 2 AS change_flags, ino // 5 % 2 * 5000 AS new_size, ino % 4 AS new_version, ino // 11 % 2 AS bits, 9::BIGINT AS new_proj FROM inodes",
    "quota_inputs": "SELECT ino AS req, proj, uid, gid, CASE WHEN ino % 2 = 0 THEN 'I' ELSE 'D' END AS op FROM inodes",
    "mounts": "SELECT user_id % 5 AS rid, event_id + 1 AS ino FROM events",
}
_NEEDS = {"seq_index": ["inodes"], "xattrs": ["tags"], "totl_delta": ["tags"], "links": ["dirents"], "srch_log": ["tags"], "extents": ["tags"], "mapped": ["tags", "extents"], "quota_inputs": ["inodes"], "fresh_inodes": ["inodes"], "releases": ["inodes"], "stages": ["inodes"], "move_targets": ["inodes"], "moves": ["inodes"], "move_extents": ["inodes", "tags", "extents", "mapped"], "attr_changes": ["inodes"]}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` with the named tables, and those they need, before it; a body may begin with further tables and WITH."""
    used: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in used:
                used.append(n)
    parts = [f"{n} AS ({SQL[n]})" for n in used]
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        rest = rest[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}{', ' if parts else ''}{rest}"
    return f"WITH {', '.join(parts)} {rest}" if parts else rest
