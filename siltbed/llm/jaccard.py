"""N-gram Jaccard join by T-occurrence search.

Two documents link when the Jaccard similarity of their sets of word shingles
is at least ``share`` percent; the result is exact.  The search for partners
follows DivideSkip on two levels.

Across the cluster, the inverted lists of a document's shingles are divided
into short and long ones by one order for all documents: by the number of
documents in the list, then by hash.  All but the overlap that a partner must
have, less one, are merged: partners share at least one of these short lists,
so only they are shuffled, and of them only those with two documents or more.
The lengths come from counts over all documents of 40 bits of each shingle's
hash; two shingles with the same bits are counted together, which changes the
order, the same way for all documents, and no link.

Within a task, a query meets a block of candidates: the lists of its shingles
over the block are built, the shortest are merged by a heap, candidates with
enough occurrences are looked up in the long lists by binary search, and
those that reach the overlap required for both sizes are links.

Documents with the same words are one node; nodes are numbered in the order of
their least doc_id.  In a first pass each list is compared with its most central document only, which
unites groups of near copies at a cost linear in their size.  In a second pass
all pairs of a list whose documents are still in different components are
compared, as far as their sizes and the places in the lists leave a link
possible.  Pairs inside a component can not change it, so no link between
components is lost.

Copies are spread by a hash of doc_id where classes meet their documents, and
long lists by a hash of the node, so no task holds all of one text's copies or
all of one list's pairs.

Defined cases: texts without words and null texts have no shingles and link
with nothing; with fewer words than a shingle has, the whole sequence is one
shingle; very long texts are whole; rows that share a doc_id are documents of
their own, each with its text's set and component; rows with a null doc_id link
like others and get the least doc_id that they reach, null if there is none;
equal rows get equal results; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import COUNT_SCHEMA, TOTAL_SCHEMA, add_part, split, totals_of
from .components import connected
from .scratch import written
from .textarrays import LOWER, as_long, hash_runs, release, sequence_hash, slices, window_hashes, word_table

SHINGLE = 5
#: Bits of a shingle's hash in the counts; documents in a list from which on it is handled as a long one.
BITS, LONG = 40, 64
#: Bytes of text in a chunk, shingles in a part of the counts.
CHUNK_BYTES, PART_KEYS = 4 << 20, 1_000_000
#: Candidates compared with a query at a time; bits of the filter on the texts that are read again.
BLOCK, BUCKETS = 256, 1 << 23
#: Shares into which the copies of a text may fall; documents of a list that one task pairs with the others.
SALTS, SHARE_ROWS = 4096, 1024


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Each row's distinct shingles as ascending 64-bit hashes."""
    data = LOWER[data]
    starts, ends, first = word_table(offsets, data)
    words = hash_runs(data, starts, ends)
    windows = window_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        else:
            out.append(np.array([sequence_hash(words[a:b], b - a)] if b > a else [], np.uint64))
    return out


def least_overlap(n: int, m: int, share: int) -> int:
    """Common shingles that sets of n and m need: the least o with 100 o >= share (n + m - o)."""
    return -(-share * (n + m) // (100 + share))


# ---- what all documents tell: keys of equal texts, lengths of lists


def _profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit key of each text's words, and the sizes of the work to come."""
    for rows, offsets, data in slices(batches):
        data = LOWER[data]
        starts, ends, first = word_table(offsets, data)
        words = hash_runs(data, starts, ends)
        spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        keys = [as_long(np.array([sequence_hash(words[a:b], salt) for a, b in spans], np.uint64)) for salt in (1, 2)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, keys), pa.array(np.diff(first)), pa.array(np.diff(offsets))], names=["doc_id", "spot", "k1", "k2", "n_words", "n_bytes"])


def _nodes_of(docs: pa.Table, side: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The shingle sets of a chunk's rows that stand for their copies; equal rows once."""
    side = side.filter(pc.is_valid(side["node"]))
    node = dict(zip(zip(side["spot"].to_pylist(), side["doc_id"].to_pylist(), strict=True), side["node"].to_pylist(), strict=True))
    found = [node.pop(k, None) for k in zip(docs["spot"].to_pylist(), docs["doc_id"].to_pylist(), strict=True)]
    own = pa.array(found, pa.int64())
    some = pa.Table.from_arrays([own, docs["text"]], names=["node", "text"]).filter(pc.is_valid(own)).combine_chunks()
    for rows, offsets, data in slices(some.to_batches()):
        yield from zip(rows.column(0).to_pylist(), shingle_sets(offsets, data), strict=True)


def _count(docs: pa.Table, side: pa.Table, parts: int) -> pa.Table:
    sets = [s for _, s in _nodes_of(docs, side)]
    prints, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - BITS), return_counts=True)
    del sets
    release()
    return split(docs["chunk"][0].as_py() if docs.num_rows else 0, 1, prints, counts, parts, BITS)


_LISTS = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("common", pa.int32()), ("token", pa.int64()), ("place", pa.int32()), ("often", pa.bool_())])


def _prefixes(docs: pa.Table, side: pa.Table, share: int) -> pa.Table:
    """Each document's short lists that hold others too, in the common order, and a row without a list."""
    held = list(_nodes_of(docs, side))
    sets = [s for _, s in held]
    all_tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
    _, back = np.unique(all_tokens >> np.uint64(64 - BITS), return_inverse=True)
    lengths = totals_of(side.filter(pc.is_valid(side["totals"])), 1)[back] if len(back) else back
    node, size, common, token, place, often = ([] for _ in range(6))
    at = 0
    for doc, s in held:
        n = len(s)
        own = lengths[at : at + n]
        at += n
        taken = n - -(-share * n // 100) + 1 if n else 0
        alone = int((own == 1).sum())
        chosen = np.zeros(0, np.int64)
        if alone < taken:
            rest = np.flatnonzero(own > 1)
            chosen = rest[np.argsort(own[rest], kind="stable")][: taken - alone]
        k = len(chosen)
        node.append(np.full(k + 1, doc, np.int64))
        size.append(np.full(k + 1, n, np.int32))
        common.append(np.full(k + 1, 100 * (n - alone) // max(n, 1), np.int32))
        token.append(np.append(as_long(s[chosen]), 0))
        place.append(np.append(np.arange(alone, alone + k), -1).astype(np.int32))
        often.append(np.append(own[chosen] >= LONG, False))
    del held, sets, all_tokens, back, lengths
    release()
    flat = [np.concatenate([*x, np.zeros(0, k)]) for x, k in ((node, np.int64), (size, np.int32), (common, np.int32), (token, np.int64), (place, np.int32), (often, bool))]
    columns = [pa.array(c, f.type) for c, f in zip(flat, _LISTS, strict=True)]
    return pa.Table.from_arrays(columns, schema=_LISTS)


# ---- comparison in a task


def divide_skip(lists: list[np.ndarray], least: int, needed: list[int]) -> list[int]:
    """The candidates that occur in ``needed`` or more of the lists.

    ``lists`` are ascending numbers of candidates, one list for each shingle of the query;
    ``needed`` has the threshold of each candidate and ``least`` the smallest of them.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if not lists or len(lists) < least:
        return []
    n_long = min(least - 1, int(least / (0.01 * np.log2(len(lists[-1]) + 1) + 1)))
    split = len(lists) - n_long
    found = []
    long = [x.tolist() for x in lists[split:]]
    for candidate, group in groupby(heapq.merge(*(x.tolist() for x in lists[:split]))):
        count, rest, want = sum(1 for _ in group), n_long, needed[candidate]
        if count + rest < want:
            continue
        for x in reversed(long):
            at = bisect_left(x, candidate)
            count += at < len(x) and x[at] == candidate
            rest -= 1
            if count + rest < want or count >= want:
                break
        if count >= want:
            found.append(candidate)
    return found


def search(query: np.ndarray, candidates: list[np.ndarray], share: int) -> list[int]:
    """Places of the candidates whose similarity with the query reaches ``share`` percent."""
    needed = [least_overlap(len(query), len(c), share) for c in candidates]
    sizes = np.array([len(c) for c in candidates])
    flat = np.concatenate(candidates)
    at = np.searchsorted(query, flat)
    hit = np.flatnonzero(query[np.minimum(at, len(query) - 1)] == flat)
    which = np.repeat(np.arange(len(candidates)), sizes)[hit]
    at = at[hit]
    order = np.argsort(at, kind="stable")
    lists = np.split(which[order], np.searchsorted(at[order], np.arange(1, len(query))))
    return divide_skip(lists, min(needed), needed)


def _compare(batches: Iterable[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Links, from rows (a, salt, b, text) sorted so that a query (b null) comes before its candidates."""
    current, queries, ids, sets = None, [], [], []
    out_u, out_v = [], []

    def flush() -> None:
        for q in queries if sets else ():
            for i in search(q, sets, share):
                out_u.append(current[0])
                out_v.append(ids[i])
        ids.clear()
        sets.clear()

    for rows, offsets, data in slices(batches):
        for a, salt, b, s in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), shingle_sets(offsets, data), strict=True):
            if (a, salt) != current:
                flush()
                current, queries = (a, salt), []
            if not len(s):
                continue
            if b is None:
                queries.append(s)
            else:
                ids.append(b)
                sets.append(s)
                if len(sets) == BLOCK:
                    flush()
    flush()
    yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])


def verified(pairs: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """The links (u, v) among distinct pairs (a, b); a query with many candidates is split into blocks."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    candidates = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("salt"), "b").join(texts.withColumnRenamed("node", "b"), "b")
    queries = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt")).join(texts.withColumnRenamed("node", "a"), "a")
    rows = queries.select("a", "salt", F.lit(None).cast("long").alias("b"), "text").unionByName(candidates.select("a", "salt", "b", "text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lambda it: _compare(it, share), "u long, v long")


def _only(batches: Iterable[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.column(3).to_numpy(zero_copy_only=False)
        yield batch.select([0, 1, 2]).filter(pa.array((words[k >> 6] >> (k & 63)) & 1 == 1))


def _texts_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text) of the nodes in pairs.  A filter of fixed size, of sums made before they come to the driver, spares the shuffle most of the other texts."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(classes.join(nodes, "node", "left_semi").select("node", F.col("least").alias("doc_id"), "spot"))
    bucket = F.pmod("spot", F.lit(BUCKETS))
    sums = wanted.groupBy(F.shiftright(bucket, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(spot, {BUCKETS}) & 63 as int))")).alias("bits")).toPandas()
    words = np.zeros(BUCKETS >> 6, np.int64)
    words[sums["word"].to_numpy(np.int64)] = sums["bits"].to_numpy(np.int64)
    some = docs.select("doc_id", "text", "spot", bucket.alias("k")).mapInArrow(lambda it: _only(it, words), "doc_id long, text string, spot long")
    found = some.join(wanted.withColumnRenamed("doc_id", "of"), [some["spot"] == wanted["spot"], F.col("doc_id").eqNullSafe(F.col("of"))])
    return written(found.select("node", "text").dropDuplicates(["node"]))


def _near(a: str, b: str, share: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {share} * greatest({a}, {b})")


class Groups(NamedTuple):
    members: DataFrame  #: a row for each document: doc_id, spot (a hash of doc_id and text), k1, k2 (the words' key), n_words
    shares: DataFrame  #: a row for each text and share of its copies
    classes: DataFrame  #: a row for each text: node, least doc_id and spot, k1, k2
    sizes: DataFrame  #: node, n_shingles
    roots: DataFrame  #: node, root of the nodes that have links


def spot(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def _salted(members: DataFrame) -> DataFrame:
    return members.where("n_words > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))


def groups(docs: DataFrame, share: int = 80, chunk_bytes: int = CHUNK_BYTES, part_keys: int = PART_KEYS) -> Groups:
    """The links of a table's texts and what they join."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("spot", spot(F.col("doc_id"), F.col("text")))
    members = written(docs.select("doc_id", "spot", "text").mapInArrow(_profile, "doc_id long, spot long, k1 long, k2 long, n_words long, n_bytes long"))
    total = members.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    chunks, parts = 1 + total[0] // chunk_bytes, 1 + total[1] // part_keys
    # One row for each text and share of its copies, then one for each text, in the order of doc_id.
    shares = written(_salted(members).groupBy("k1", "k2", "salt").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "spot")).alias("first")))
    firsts = shares.groupBy("k1", "k2").agg(F.min("first").alias("first")).select("k1", "k2", F.col("first.doc_id").alias("least"), F.col("first.spot").alias("spot"))
    classes = written(firsts.orderBy(F.col("least").asc_nulls_last(), "k1", "k2").withColumn("node", F.monotonically_increasing_id()))

    chunk = F.pmod(F.col("spot"), F.lit(chunks)).cast("int").alias("chunk")
    dealt = docs.select("doc_id", "text", "spot", chunk)
    nodes = classes.select("node", F.col("least").alias("doc_id"), "spot", chunk)
    counted = dealt.groupBy("chunk").cogroup(nodes.groupBy("chunk")).applyInArrow(lambda d, n: _count(d, n, parts), COUNT_SCHEMA)
    totals = counted.groupBy("part").applyInArrow(add_part, TOTAL_SCHEMA)
    side = nodes.unionByName(totals, allowMissingColumns=True)
    lists = written(dealt.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(lambda d, n: _prefixes(d, n, share), "node long, size int, common int, token long, place int, often boolean"))
    # A partner whose first common shingle stands at this place has at most so many shingles.
    most = F.expr(f"cast(((100 + {share}) * (size - place) - {share} * size) div {share} as int)").alias("most")
    shared = written(_lists(lists.where("place >= 0").select("token", "node", "size", most, "common", "often")))
    sizes = lists.where("place < 0").select("node", F.col("size").cast("long").alias("n_shingles"))

    fits = (F.col("size") <= F.col("hub_most")) & (F.col("hub_size") <= F.col("most"))
    first = written(shared.where("node <> hub").where(fits & _near("size", "hub_size", share)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = written(verified(first, _texts_of(first, docs, classes), share))
    labels = connected(links)
    second = written(_across(shared, labels, share).join(first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti"))
    more = written(verified(second, _texts_of(second, docs, classes), share))
    roots = connected(links.unionByName(more))
    return Groups(members, shares, classes, sizes, roots)


def components(docs: DataFrame, share: int = 80, chunk_bytes: int = CHUNK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links."""
    members, shares, classes, sizes, roots = groups(docs, share, chunk_bytes, part_keys)
    # What a text's documents get, by text, then by share of its copies, then by document.
    named = roots.join(classes.select(F.col("node").alias("root"), F.col("least").alias("label")), "root").select("node", "label")
    known = classes.join(sizes, "node").join(named, "node", "left").select("k1", "k2", "n_shingles", F.coalesce("label", "least").alias("component_id"))
    spread = shares.select("k1", "k2", "salt").join(known, ["k1", "k2"])
    filled = _salted(members).join(spread, ["k1", "k2", "salt"]).select("doc_id", "n_shingles", "component_id")
    return filled.unionByName(members.where("n_words = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each_group(docs: DataFrame, share: int = 80, **how: int) -> DataFrame:
    """The rows of which each group of linked documents keeps one, with all their columns.

    It is the row of least doc_id (null last), then of least key of its words; of rows that share that doc_id and
    text the one of least hash of all columns (maps aside).  Texts without words stay, each row of them.
    """
    found = groups(docs, share, **how)
    first = found.classes.join(found.roots, "node", "left").where("root is null or root = node").select(F.col("least").alias("doc_id"), "spot")
    times = found.members.groupBy("doc_id", "spot").agg(F.count("*").alias("times")).where("times > 1")
    named = {c.lower() for c in docs.columns}
    own, rank = (next(f"__{what}{i}" for i in range(len(named) + 1) if f"__{what}{i}" not in named) for what in ("spot", "rank"))
    rows = docs.withColumn(own, spot(F.col("doc_id"), F.col("text")))
    same = lambda keys: [rows[own] == keys["spot"], rows["doc_id"].cast("long").eqNullSafe(keys["doc_id"])]
    kept = rows.join(first, same(first), "left_semi")
    alone = kept.join(times, same(times), "left_anti")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = Window.partitionBy("doc_id", own).orderBy(F.xxhash64(*plain))
    copies = kept.join(times, same(times), "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    wordless = docs.where(~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return alone.select(*columns).unionByName(copies.select(*columns)).unionByName(wordless)


def _lists(lists: DataFrame) -> DataFrame:
    """The rows of lists with two documents or more, with the list's most central document as hub."""
    hub = F.max(F.struct("common", (-F.col("node")).alias("minus"), "size", "most"))
    by = Window.partitionBy("token")
    short = lists.where("not often").withColumn("n", F.count("*").over(by)).where("n > 1").withColumn("h", hub.over(by)).drop("n")
    frequent = lists.where("often")
    hubs = frequent.groupBy("token").agg(hub.alias("h"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = short.unionByName(frequent.join(hubs, "token"))
    return rows.select("token", "node", "size", "most", (-F.col("h.minus")).alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.most").alias("hub_most"))


def _across(shared: DataFrame, labels: DataFrame, share: int) -> DataFrame:
    """Distinct pairs (a, b) of a list in different components that sizes and places leave possible."""
    rows = shared.join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("token", "node", "size", "most", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("size").alias("least"), F.max("most").alias("largest"), F.ceil(F.count("*") / SHARE_ROWS).cast("int").alias("shares")).where("r < s").drop("r", "s")
    # Rows that no partner in the list can fit.
    rows = rows.join(mixed, "token").where("most >= least and size <= largest").drop("least", "largest")
    x = rows.select("token", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("salt"), *[F.col(c).alias(f"x_{c}") for c in ("node", "size", "most", "root")])
    y = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), *[F.col(c).alias(f"y_{c}") for c in ("node", "size", "most", "root")])
    pairs = x.join(y, ["token", "salt"]).where("x_root <> y_root and x_node < y_node and x_size <= y_most and y_size <= x_most").where(_near("x_size", "y_size", share))
    return pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
