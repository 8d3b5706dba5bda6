"""A training corpus from raw documents: quality, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents. Rows with a null id count as those of
the smallest id, null texts as empty; an empty table gives an empty one; each operator's docstring has the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.byte_cnn import fit_quality, with_quality
from waymark.llm.common import fresh, stage
from waymark.llm.mixing import mixed_documents
from waymark.llm.packing import pack_documents
from waymark.llm.queries import tokenizer_path
from waymark.llm.similar import drop_near_duplicates
from waymark.llm.substring import drop_repeats

#: Documents with a lower probability of good quality go.
QUALITY = 0.5
#: Near-duplicates have this Jaccard similarity of five-word shingles at least; pairs just at it are met with this chance.
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.98

#: No SQL: the stages learn a model, hash texts and tokenise.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, trained on the labels of these documents, finds good."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "score")
    return with_quality(docs, model, score).where(F.col(score) >= QUALITY).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id: wide SimHash, verified by whole sets."""
    return drop_near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY, recall=RECALL)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words and more that stand earlier in the corpus; n_chars follows the text."""
    cut = drop_repeats(docs)
    changed = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return cut.withColumns(changed).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, at most twice, toward nine tenths of the greatest entropy at least; loses none."""
    return mixed_documents(docs, entropy_share=0.9, max_repeats=2, budget="cover", most_exponent=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
