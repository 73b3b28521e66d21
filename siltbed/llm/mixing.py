"""Mixing sources to target weights under a hierarchical token budget.

The tree is domain > language > source; a leaf's capacity is its tokens times
``max_epochs``.  A node's budget goes to its children by weight; what a child
cannot hold goes to its siblings, again by weight, and only what the whole
group cannot hold goes further up (a group is never promised more than its
leaves hold).  A leaf with supply s and budget b takes floor(b / s) whole
epochs and then the first b mod s tokens of one more epoch, whose order is a
seeded hash of the documents.

A leaf may hold a third of all rows, so its order is never sorted as one
group: rows fall into about as many buckets as the square root of the leaf's
rows by the leading digits of the hash, bucket sums are accumulated, and only
the bucket in which the budget ends is ordered, by keys and token counts
alone.  That gives the place where the budget ends, with which every row is
then compared by itself.

A shortage counts only leaves that may get tokens: what lies under a weight of
0 adds nothing to what its ancestors can hold.

Defined cases: null domain, language or source is the node 'none'; null and
empty texts have 0 tokens and follow their leaf (they are taken while tokens
remain); very long texts are counted whole; the order of a row without a doc_id
comes from a hash of its text; rows of equal hashes are ordered by a hash of
all their columns (maps aside), and rows that are equal in all of them are
separate documents, of which any takes the remainder; an empty table gives an
empty result; a node with weight 0 gets nothing; other columns, whatever their
names, are kept by ``select`` and ignored by ``plan_rows``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "source": {},
}
SEED, MAX_EPOCHS, SHARE = 17, 4, 1.0


def domain_of(source: Column) -> Column:
    """The default tree: the number at a source's end, modulo four."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _leaf(docs: DataFrame) -> list[Column]:
    source = F.col("source").cast("string")
    domain = F.col("domain").cast("string") if "domain" in docs.columns else domain_of(source)
    lang = F.col("lang").cast("string")
    return [F.coalesce(c, F.lit("none")).alias(name) for name, c in zip(LEVELS, (domain, lang, source), strict=True)]


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    known = weights.get(level) or {}
    out = F.lit(1.0)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def water_fill(rows: DataFrame, group: list[str], name: str, out: str, many: bool = True) -> DataFrame:
    """Splits ``budget`` of each group over its rows by ``weight``, none above ``capacity``, in whole tokens."""
    by = Window.partitionBy(*group)
    order = by.orderBy("__ratio", name)
    rows = rows.withColumn("__ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    rows = rows.withColumn("__n", F.row_number().over(order))
    rows = rows.withColumn("__before", F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("capacity"))
    # A frame to the last row is summed anew for each, so groups of many rows use a running sum from the other end.
    rest = by.orderBy(F.desc("__ratio"), F.desc(name)).rowsBetween(Window.unboundedPreceding, 0) if many else order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("__after", F.sum("weight").over(rest))
    rows = rows.withColumn("__level", F.when(F.col("__after") > 0, (F.col("budget") - F.col("__before")) / F.col("__after")))
    first = F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__n", "__level"))).over(by)
    rows = rows.withColumn("__level", first["__level"])
    share = F.when(F.col("weight") <= 0, 0.0).when(F.col("__level").isNull(), F.col("capacity").cast("double")).otherwise(F.least(F.col("capacity").cast("double"), F.col("__level") * F.col("weight")))
    rows = rows.withColumn("__share", share)
    rows = rows.withColumn("__sum", F.sum("__share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.floor(F.col("__sum") + 0.5) - F.floor(F.col("__sum") - F.col("__share") + 0.5)
    return rows.withColumn(out, F.least(whole.cast("long"), F.col("capacity"))).drop("__ratio", "__n", "__before", "__after", "__level", "__share", "__sum")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """domain, lang, source, supply, budget, from domain, lang, source, supply.

    The budget of the root is ``share`` of all tokens.  Domains and languages are few; sources may be many.
    """
    total = leaves.agg(F.round(F.coalesce(F.sum("supply"), F.lit(0)) * F.lit(share)).cast("long").alias("budget"))
    open_leaf = reduce(Column.__and__, [_weight(level, weights) > 0 for level in LEVELS])
    leaves = leaves.withColumn("capacity", F.when(open_leaf, F.col("supply") * max_epochs).otherwise(0))
    above = total
    for depth in range(1, len(LEVELS) + 1):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply")).withColumn("weight", _weight(keys[-1], weights))
        nodes = nodes.crossJoin(F.broadcast(above)) if depth == 1 else nodes.join(above, keys[:-1])
        nodes = water_fill(nodes, keys[:-1] or [F.lit(0)], keys[-1], "given", many=depth == len(LEVELS))
        above = nodes.select(*keys, F.col("given").alias("budget"), *(["supply"] if depth == len(LEVELS) else []))
    return above


def _order(seed: int) -> Column:
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string")))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), who).cast("binary"))


def _tie(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain).alias("tie")


def _keys(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), *_leaf(docs), token_count(F.col("text").cast("string")).alias("n_tokens"), _tie(docs)]


def _cuts(slim: DataFrame, plan: DataFrame, seed: int, buckets: int | None) -> DataFrame:
    """Each leaf's plan with the place in its order where the budget ends and the tokens before that place."""
    whole = F.when(F.col("supply") > 0, F.call_function("div", F.col("budget"), F.col("supply"))).otherwise(0)
    part = F.when(F.col("supply") > 0, F.col("budget") % F.col("supply")).otherwise(0)
    n_buckets = F.lit(buckets) if buckets else F.ceil(F.sqrt("rows"))
    plan = written(plan.select(*LEVELS, whole.alias("epochs"), part.alias("part"), n_buckets.cast("long").alias("buckets")))
    bucket = F.shiftright(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * F.col("buckets"), 32)
    keyed = slim.join(plan.where("part > 0"), list(LEVELS)).withColumn("order_key", _order(seed)).withColumn("bucket", bucket)
    sums = keyed.groupBy(*LEVELS, "part", "bucket").agg(F.sum("n_tokens").alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("part")).groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("held")).alias("before"))).alias("e"))
    ends = ends.select(*LEVELS, F.col("e.bucket").alias("bucket"), F.col("e.before").alias("before"))
    inner = keyed.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "part", "before", "order_key", "tie").agg(F.sum("n_tokens").alias("held"))
    upto = F.col("before") + F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("order_key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    cut = inner.withColumn("upto", upto).where(F.col("upto") >= F.col("part")).groupBy(*LEVELS).agg(F.min(F.struct("order_key", "tie", (F.col("upto") - F.col("held")).alias("before"))).alias("cut"))
    return written(plan.join(cut, list(LEVELS), "left").drop("buckets"))


def _taken(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Adds last_tokens, how many tokens the last, partial epoch takes of a row, and in_last, whether it holds the row."""
    rows = rows.join(plan, list(LEVELS)).withColumn("order_key", _order(seed))
    here, place = F.struct("order_key", "tie"), F.struct("cut.order_key", "cut.tie")
    at_cut = F.coalesce(here == place, F.lit(False))
    ahead = F.coalesce(here < place, F.lit(False))
    plain = rows.where(~at_cut).withColumn("last_tokens", F.when(ahead, F.col("n_tokens")).otherwise(0).cast("long")).withColumn("in_last", ahead)
    # Rows at the cut are equal in all columns; mostly there is one.
    before = F.col("cut.before") + (F.row_number().over(Window.partitionBy(*LEVELS).orderBy("tie")) - 1) * F.col("n_tokens")
    last = rows.where(at_cut).withColumn("ahead", before).withColumn("last_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("part") - F.col("ahead"))).cast("long"))
    return plain.unionByName(last.withColumn("in_last", F.col("ahead") < F.col("part")).drop("ahead"))


def _plan(slim: DataFrame, weights: Mapping[str, Mapping[str, float]], share: float, max_epochs: int, seed: int, buckets: int | None) -> DataFrame:
    leaves = written(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("rows")))
    budgets = leaf_budgets(leaves.select(*LEVELS, "supply"), weights, share, max_epochs)
    return _cuts(slim, budgets.join(leaves.select(*LEVELS, "rows"), list(LEVELS)), seed, buckets)


def plan_rows(docs: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """A row for each document: doc_id, domain, lang, source, n_tokens, epochs (whole ones), last_tokens, taken_tokens."""
    slim = written(docs.select(*_keys(docs)))
    rows = _taken(slim, _plan(slim, weights, share, max_epochs, seed, buckets), seed)
    return rows.select("doc_id", *LEVELS, "n_tokens", F.col("epochs").cast("long").alias("epochs"), "last_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("last_tokens")).cast("long").alias("taken_tokens"))


def select(docs: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """The documents of the mixture with all their columns, once for each epoch that holds them.

    The document in which a leaf's last epoch ends is taken whole.
    """
    slim = written(docs.select(*_keys(docs)))
    body = docs.select(*_keys(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _taken(body, _plan(slim, weights, share, max_epochs, seed, buckets), seed).withColumn("times", (F.col("epochs") + F.col("in_last").cast("long")).cast("int"))
    return rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch")).select("row.*")
