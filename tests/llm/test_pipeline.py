"""The pipeline's stages, each on its own input, against plain versions."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from siltbed.llm import mixing, queries, toxicity

from ..conftest import SF
from .test_plain_versions import plain_severity
from .test_text_operators import LIBRARY, brute_components


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "toxicity":
            clean = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
            assert clean.join(before, "doc_id").join(docs, "doc_id", "left_anti").count() <= 2
        elif name == "ngram_jaccard":
            groups = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted({root for _, root in groups.values()})
        elif name == "pii":
            assert docs.count() == before.count()
        elif name == "mixing":
            plan = mixing.plan_rows(before).where("taken_tokens > 0 or (n_tokens = 0)")
            assert docs.select("doc_id").distinct().join(plan, "doc_id", "left_anti").count() == 0
            assert plan.where("taken_tokens > 0").join(docs, "doc_id", "left_anti").count() == 0
        else:
            texts = {r.doc_id: r.text for r in before.collect()}
            assert docs.count() == before.count()
            for r in docs.collect():
                assert list(r.ids) == LIBRARY.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_equals_its_stages(spark):
    out = queries.pipeline(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert out.where(F.col("n_tokens") != F.size("ids")).count() == 0 and out.count() > 0
    assert public_tokenizers.path(corpus_pipeline.RANKS)


ODD = "doc_id long, text string, lang string, source string, n_chars long, __n long, __spot0 string, __rank0 string, tie string, row string"


def odd_rows():
    long = " ".join(f"w{i}" for i in range(100))
    near = long.replace("w7 ", "W7 other ")
    texts = [(1, None), (1, ""), (2, long), (2, near), (3, long), (None, long), (None, "alone and without any name at all"), (4, "me@x.example.com said so"), (4, "me@x.example.com said so"), (4, "another text of document four"), (5, " \n "), (6, "word " * 30000)]
    return [(i, t, "en" if i else None, None if i == 3 else "s1", 1, 7, "s", "r", "t", "w") for i, t in texts]


def test_stages_on_odd_rows(spark, tmp_path):
    given = spark.createDataFrame(odd_rows(), ODD)
    spark.createDataFrame([(2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, str(tmp_path)).collect()
        if name == "byte_bpe":
            assert [r.n_tokens for r in out if r.doc_id == 1] == [0, 0] and len(out) == given.count()
            continue
        assert all(r.asDict().keys() == set(given.columns) and r["__n"] == 7 and r["__spot0"] == "s" for r in out)
        if name in ("toxicity", "pii"):
            assert len(out) == given.count()
        elif name == "ngram_jaccard":
            kept = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:7]) for r in out)
            # 2 keeps one of its two near copies, 3 and the nameless copy go; 4 has two texts.
            assert kept == [(False, 1, ""), (False, 1, ""), (False, 2, "w0 w1 w"), (False, 4, "another"), (False, 4, "me@x.ex"), (False, 5, " \n "), (False, 6, "word wo"), (True, 0, "alone a")]
    for r in pseudonym_rows(spark, given):
        assert "me@x" not in (r.text or "")


def pseudonym_rows(spark, given):
    return dict(corpus_pipeline.STAGES)["pii"](spark, given, SF).collect()


def test_stages_on_empty_tables(spark, tmp_path):
    given = spark.createDataFrame([], ODD)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, given, str(tmp_path)).count() == 0


def test_toxic_documents_go_as_the_plain_score_says(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SF).collect()}
    for r in docs.collect():
        assert (r.doc_id in kept) == (plain_severity(r.text, model)[1] < 0.5)
