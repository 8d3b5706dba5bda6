"""Queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .ann_tree import nearest
from .byte_cnn import fit_quality, quality_scores
from .common import SPACE_CLASS
from .fill_in_middle import fill_in_middle, restored
from .hard_negatives import mine_negatives
from .mixing import mix_sources
from .oracles import ORACLES as ORACLES
from .packing import pack_documents
from .personal_data import KINDS, find_personal_data
from .quality_rules import judge_quality
from .simhash import near_duplicates
from .substring import remove_repeats
from .url_model import judge_urls
from .warc import lookup, write_archive

URL_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = lookup(write_archive(pages), pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), entropy_share=0.9, max_repeats=4)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit_quality(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    kept = F.trim(F.regexp_replace("kept_text", f"{SPACE_CLASS}+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    fim = F.col("fim")
    shas = F.sha2(fim["output"], 256).alias("output_sha256"), F.sha2(restored(fim), 256).alias("restored_sha256")
    return made.select("doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix"].alias("prefix_chars"), fim["middle"].alias("middle_chars"), *shas)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("pii")["spans"]
    plain = F.filter(spans, lambda s: s["plain"])
    told = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = (F.size(spans) - F.size(plain)).cast("long").alias("n_added")
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(count, KINDS), F.sha2(told(plain), 256).alias("base_sha256"), told(spans).alias("spans"), added)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_warc, op3_mixing, op4_packing, op5_byte_cnn, op6_simhash, op7_url_filter, op8_ann, op9_substring, op10_licenses, op11_fill_in_middle, op12_hard_negatives, op13_personal_data)
}
