"""Registered queries of the corpus operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import read, remainder, written
from .divergence import divergence, divergence_sql
from .hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from .id_files import read_ids, write_ids
from .jaccard_join import jaccard_join
from .language_id import language_id
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import mixing
from .packing import pack
from .quality import quality
from .quality_rules import quality_rules
from .quality_rules_sql import quality_rules_sql
from .toxicity import toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_passages", "top_passage")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"), n=3, percent=90)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read(spark, sf_dir, "documents"), min_chars=20, near_chars=40, edits=2)
    return found.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing(read(spark, sf_dir, "documents"), temper=0.9, keep=["doc_id", "source", "lang"])
    return found.select(
        "doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "multiplicity", "selected", "copies"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 3) == 1
    found = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "max_distance")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "first_line", "last_line", "license", "reduction", "n_changed", "exact")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = language_id(read(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), TOKENIZER, 1024)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(written(write_ids(read(spark, sf_dir, "documents"), TOKENIZER, end_id=2), "ids"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"), min_docs=3, top=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_quality": op2_quality,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_token_ids": op11_token_ids,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_divergence": op13_divergence,
}

ORACLE: dict[str, str] = {
    "op5_quality_rules": quality_rules_sql(),
    "op12_hard_negatives": HARD_NEGATIVES_SQL,
    "op13_divergence": divergence_sql(),
}
