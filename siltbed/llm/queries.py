"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, gif, jaccard, licenses, mixing, ngram_lm, pseudonyms, quality, toxicity

RANKS = "byte_bpe_50k.tiktoken"
#: Where the session sets no key, as in a check; pseudonyms under it hide nothing from those who read this.
PUBLIC_KEY = "siltbed"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.backoff_scores(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_rows(_table(spark, sf_dir, "documents"))


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.round_trip(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.format_chat(turns.unionByName(probe)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get(pseudonyms.KEY_SETTING, PUBLIC_KEY)
    return pseudonyms.pseudonymise(docs, key, findings="kinds").select("doc_id", "text", F.size("kinds").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_lm_scoring, op4_mixing, op5_gif, op6_byte_bpe, op7_chat, op8_pii, op9_license_scan, op10_quality_rules, pipeline)}

_ESCAPED = "replace(replace(replace(text, '\\', '\\b'), '#', '\\h'), '<', '\\l')"

ORACLE_SQL: dict[str, str] = {
    "op7_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
m AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '<' || replace(replace(replace(replace(role, '\\', '\\b'), '#', '\\h'), '<', '\\l'), ':', '\\c') || '>' END) + 2 + length({_ESCAPED}) + 8)::BIGINT AS formatted_chars,
  bool_and(prev || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM m GROUP BY conv_id""",
    "op1_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in generate_series(1, len(w) - 4)]) END AS s FROM w),
c AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
e AS (SELECT node, n, unnest(s) AS t FROM c),
k AS (
  SELECT a.node AS u, b.node AS v FROM e a JOIN e b ON a.t = b.t AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
b AS (SELECT u, v FROM k UNION SELECT v, u FROM k),
r AS (SELECT node AS v, node AS root FROM c UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.v WHERE r.root <= b.v),
f AS (SELECT v, min(root) AS root FROM r GROUP BY v)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE f.root END AS component_id
FROM s d JOIN c ON c.s = list_sort(d.s) JOIN f ON f.v = c.node""",
    "op4_mixing": """
WITH d AS (
  SELECT doc_id, coalesce(CASE WHEN regexp_extract(source, '([0-9]{1,9})$', 1) <> '' THEN 'domain' || (regexp_extract(source, '([0-9]{1,9})$', 1)::INT % 4) END, 'none') AS domain,
    coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, (4 * sum(n_tokens))::BIGINT AS capacity FROM d GROUP BY ALL),
""" + ",\n".join(
        f"""
n{i} AS (SELECT {keys}, sum(capacity)::BIGINT AS capacity, sum(supply)::BIGINT AS supply, {weight} AS weight FROM leaf GROUP BY {keys}),
r{i} AS (SELECT n{i}.*, {budget} AS budget, CASE WHEN weight > 0 THEN capacity / weight ELSE 'inf'::DOUBLE END AS ratio FROM n{i} {join}),
l{i} AS (SELECT *, row_number() OVER o AS rn, (budget - (sum(capacity) OVER (o ROWS UNBOUNDED PRECEDING) - capacity)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r{i} WINDOW o AS ({part} ORDER BY ratio, {name})),
m{i} AS (SELECT *, arg_min(CASE WHEN ratio >= level THEN level END, rn) FILTER (ratio >= level) OVER ({part}) AS cut FROM l{i}),
h{i} AS (SELECT *, CASE WHEN weight <= 0 THEN 0.0 WHEN cut IS NULL THEN capacity::DOUBLE ELSE least(capacity::DOUBLE, cut * weight) END AS share FROM m{i}),
g{i} AS (SELECT {keys}, supply, least(capacity, (floor(t + 0.5) - floor(t - share + 0.5))::BIGINT) AS given FROM (SELECT *, sum(share) OVER ({part} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING) AS t FROM h{i}))"""
        for i, (keys, name, part, weight, budget, join) in enumerate(
            (
                ("domain", "domain", "", "CASE domain WHEN 'domain0' THEN 0.4::DOUBLE WHEN 'domain1' THEN 0.3 WHEN 'domain2' THEN 0.2 WHEN 'domain3' THEN 0.1 ELSE 1.0 END", "(SELECT sum(supply) FROM leaf)::BIGINT", ""),
                ("domain, lang", "lang", "PARTITION BY domain", "CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 1.0 END", "g0.given", "JOIN g0 USING (domain)"),
                ("domain, lang, source", "source", "PARTITION BY domain, lang", "1.0::DOUBLE", "g1.given", "JOIN g1 USING (domain, lang)"),
            )
        )
    ) + """,
p AS (SELECT *, CASE WHEN supply > 0 THEN given // supply ELSE 0 END AS epochs, CASE WHEN supply > 0 THEN given % supply ELSE 0 END AS part FROM g2),
o AS (
  SELECT d.*, p.epochs, p.part, sum(d.n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('17|' || p.epochs || '|' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) - d.n_tokens AS before
  FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, epochs::BIGINT AS epochs, greatest(0, least(n_tokens, part - before))::BIGINT AS last_tokens,
  (epochs * n_tokens + greatest(0, least(n_tokens, part - before)))::BIGINT AS taken_tokens FROM o""",
}
