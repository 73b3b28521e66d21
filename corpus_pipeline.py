"""From raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import bpe, jaccard, mixing, pseudonyms, queries, toxicity
from siltbed.llm.scratch import written

RANKS = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade stays under one half.

    Null and empty texts are no toxic ones and stay; repeated rows are judged alike; without labels of both kinds,
    or with an empty table, nothing goes; columns of any name are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of least doc_id.

    Different texts that share a doc_id are different documents; a null doc_id comes last in its group, and is kept
    if it has no other; of equal rows one stays; null texts and texts without words have no copies and stay; an
    empty table stays empty; columns of any name are kept.
    """
    return jaccard.one_of_each_group(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format.

    The key is the session's, or the public one of the registered queries.  Null and empty texts stay as they are;
    equal values get equal pseudonyms in all rows; an empty table stays empty; columns of any name are kept.
    """
    return pseudonyms.pseudonymise(docs, spark.conf.get(pseudonyms.KEY_SETTING, queries.PUBLIC_KEY))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents, once for each epoch that holds them.

    Null languages and sources are nodes of their own; null and empty texts hold no tokens and follow their leaf;
    rows without a doc_id are ordered by their text and ties by all columns; an empty table stays empty; columns
    of any name are kept.
    """
    return mixing.select(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: a row for each row.

    A null text has no tokens; null doc_ids stay null; an empty table gives no rows; other columns are left out.
    """
    return bpe.encode(docs, public_tokenizers.path(RANKS)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", hide_private),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The join's components and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
