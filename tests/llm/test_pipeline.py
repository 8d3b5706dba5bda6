"""The corpus pipeline, stage by stage, against brute force and on odd tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import DATA
from waymark.llm.byte_cnn import fit_quality, quality_scores
from waymark.llm.packing import pack_documents
from waymark.llm.queries import tokenizer_path

from .test_similar import plain_groups
from .test_substring import plain as plain_repeats

D = f"{DATA}/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "substrings", "mixture", "packed"]
    kept = steps["quality"](spark, docs, D).cache()
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    good, bad = [i in ids for i, y in labels.items() if y == 1], [i in ids for i, y in labels.items() if y == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    scores = quality_scores(docs, fit_quality(docs, spark.read.parquet(f"{D}/labels.parquet"))).collect()
    assert ids == {r["doc_id"] for r in scores if r["score"] >= corpus_pipeline.QUALITY}
    single = steps["near_duplicates"](spark, kept, D).cache()
    groups = plain_groups([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))
    cut = steps["substrings"](spark, single, D).cache()
    assert cut.columns == docs.columns
    want = plain_repeats([(r["doc_id"], r["text"]) for r in single.collect()])
    assert {r["doc_id"]: (r["text"] or "").encode().split() for r in cut.collect()} == {i: words for i, (_, _, words) in want.items()}
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0
    mixed = steps["mixture"](spark, cut, D).cache()
    assert mixed.columns == docs.columns
    uses = Counter(r["doc_id"] for r in mixed.collect())
    assert set(uses) == {r["doc_id"] for r in cut.collect()} and max(uses.values()) <= 2
    packed = steps["packed"](spark, mixed, D).collect()
    assert {r["doc_id"] for r in packed} == set(uses)
    fields = [c for c in packed[0].asDict() if c not in ("sequence_id", "offset")]
    again = pack_documents(cut, tokenizer_path("word_bpe_49k.json")).select(*fields).collect()
    assert Counter(tuple(r[c] for c in fields) for r in packed) == Counter({tuple(r[c] for c in fields): uses[r["doc_id"]] for r in again})


def test_run(spark):
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "substrings", "mixture"])
def test_odd_tables(spark, docs, odd_docs, no_docs, name):
    """Nulls, repeated rows, very long texts and columns with working names pass; nothing is invented, columns stay."""
    step, sf = dict(corpus_pipeline.STAGES)[name], f"{DATA}/sf0.001"
    assert step(spark, no_docs, sf).count() == 0
    named = odd_docs.selectExpr("*", "'a' as _score", "'b' as _key", "'c' as __key", "'d' as __source", "'e' as _doc", "'f' as _at", "'g' as _whole")
    for table in (docs, named):
        made = step(spark, table, sf)
        assert made.columns == table.columns
        same = [c for c in table.columns if c not in ("text", "n_chars")]
        assert {tuple(r[c] for c in same) for r in made.collect()} <= {tuple(r[c] for c in same) for r in table.collect()}


def test_packing_odd_tables(spark, docs, odd_docs, no_docs):
    step = corpus_pipeline.packed
    assert step(spark, no_docs, D).count() == 0
    assert {r["doc_id"] for r in step(spark, odd_docs, D).collect()} == {None, 5, 7, 8}
    assert {r["doc_id"] for r in step(spark, docs, D).collect()} == {r["doc_id"] for r in docs.collect()}


def test_unlike_texts_under_one_id_all_stay(spark):
    rows = [(1, "the first text of several words", "x"), (1, "another one, not at all alike", "x"), (None, "a third without id, again unlike", "y"), (None, "and the fourth is a new story", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("near_duplicates", "substrings", "mixture"):
        assert {r["text"] for r in dict(corpus_pipeline.STAGES)[name](spark, df, D).collect()} == {r[1] for r in rows}
