"""The mixture on rows that repeat, tie or have no id, against a plain version."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from siltbed.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, note string"


def test_no_capacity_under_a_weight_of_zero(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 100), ("d", "fr", "b", 10), ("e", "en", "c", 100)], "domain string, lang string, source string, supply long")
    weights = {"domain": {"d": 0.5, "e": 0.5}, "lang": {"en": 1.0, "fr": 1.0}, "source": {"a": 0.0}}
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, weights, share=100 / 210, max_epochs=1).collect()}
    assert got == {"a": 0, "b": 10, "c": 90}
    # A language of weight 0 in one domain only: its domain's other language is all that domain can hold.
    leaves = spark.createDataFrame([("d", "en", "a", 100), ("d", "fr", "b", 10), ("e", "fr", "c", 100)], "domain string, lang string, source string, supply long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, {"domain": {"d": 0.5, "e": 0.5}, "lang": {"en": 0.0}}, share=100 / 210, max_epochs=1).collect()}
    assert got == {"a": 0, "b": 10, "c": 90}


def rows(seed=3):
    r = random.Random(seed)
    out = []
    for i in range(300):
        text = r.choice([None, "", *(" ".join("w" for _ in range(r.randrange(1, 30))) for _ in range(6))])
        out.append((r.choice([None, i, i, i % 20]), text, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "s3", "s3", None]), r.choice(["x", "y"])))
    return out + out[:60] + [out[5]] * 40


def test_prefix_in_one_order_whatever_the_buckets(spark):
    given = spark.createDataFrame(rows(), SCHEMA)
    tokens = mixing.token_count(F.col("text"))
    results = []
    for buckets in (1, 5, None):
        plan = mixing.plan_rows(given, share=0.7, buckets=buckets).collect()
        results.append(collections.Counter(tuple(r) for r in plan))
        budgets = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(given.select(*mixing._leaf(given), tokens.alias("n")).groupBy(*mixing.LEVELS).agg(F.sum("n").alias("supply")), share=0.7).collect()}
        spent = collections.Counter()
        for r in plan:
            spent[(r.domain, r.lang, r.source)] += r.taken_tokens
        assert spent == {k: v for k, v in budgets.items()}
    assert results[0] == results[1] == results[2]


def test_order_equals_a_plain_version(spark):
    given = [(i, " ".join("w" for _ in range(i % 17)), "en", "s1", "x") for i in range(120)]
    plan = {r.doc_id: r for r in mixing.plan_rows(spark.createDataFrame(given, SCHEMA), share=0.4).collect()}
    supply = sum(i % 17 for i in range(120))
    budget = round(supply * 0.4)
    left = budget % supply
    for i in sorted(range(120), key=lambda i: hashlib.md5(f"17|{budget // supply}|{i}".encode()).hexdigest()):
        take = min(left, i % 17)
        assert plan[i].last_tokens == take and plan[i].taken_tokens == take
        left -= take
    assert left == 0


def test_select_keeps_columns_of_any_name(spark):
    given = spark.createDataFrame(rows(), SCHEMA).withColumn("tie", F.lit(1)).withColumn("cut", F.lit("c")).withColumn("row", F.lit(2.0)).withColumn("m", F.create_map(F.lit("a"), F.col("note")))
    out = mixing.select(given, share=0.7)
    assert out.columns == given.columns and out.schema["m"] == given.schema["m"]
    times = out.groupBy("doc_id", "text", "lang", "source", "note").count().collect()
    plan = mixing.plan_rows(given, share=0.7).agg(F.sum(F.col("epochs")), F.sum(F.when(F.col("last_tokens") > 0, 1).otherwise(0))).first()
    assert plan[0] + plan[1] <= sum(r["count"] for r in times) <= given.count() * 4
