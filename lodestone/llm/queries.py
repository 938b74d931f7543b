"""The corpus operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, lm, near_duplicates, packing, pii, quality, quality_rules, substrings, token_counts, urls
from lodestone.llm import sql
from lodestone.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 2048


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), VOCABULARY))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.find(documents, pii.train(documents))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.scores(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of quality."""
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return lm.scores(table(spark, sf_dir, "documents"), target, VOCABULARY)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.Items(table(spark, sf_dir, "benchmark"))
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), items))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.totals(table(spark, sf_dir, "documents"), VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_lm_scores": op6_lm_scores,
    "op7_substrings": op7_substrings,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
}

SQL: dict[str, str] = {
    "op2_near_duplicates": sql.NEAR_DUPLICATES,
    "op7_substrings": sql.SUBSTRING_DUPLICATES,
    "op8_decontaminate": sql.DECONTAMINATION,
}
