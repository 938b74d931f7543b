"""The corpus pipeline: quality, near copies, benchmark passages, personal data, packing.

Every stage takes the session, its documents and the folder of the test tables. All but the
last return the columns of the table documents, with n_chars as the stage leaves the text.

Every stage takes nulls in any column, repeated rows, texts of any length and an empty table.
A null text counts as empty: the classifier scores it so, it is a near copy of nothing, has no
benchmark words and no personal data, and is packed as its end token alone. A null label, or one
of an id without a document, teaches nothing. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, near_duplicates, packing, pii, quality
from lodestone.llm.common import table, written
from lodestone.llm.queries import VOCABULARY

MAX_COVERAGE = 0.5
"""Share of a document's words that benchmark windows may cover before all of it goes."""


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, trained on labelled ones, takes for bad. Without labels, or with those of one class, none is bad unless that class is."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest id, the first of repeated ones; rows without words are all kept."""
    return near_duplicates.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what repeats benchmark items, and drops documents that are mostly such. Null texts and empty benchmarks change nothing."""
    return _measured(decontaminate.remove(docs, decontaminate.Items(table(spark, sf_dir, "benchmark")), max_coverage=MAX_COVERAGE))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and secrets, in repeated rows alike; null texts stay null."""
    return _measured(pii.mask(docs, pii.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' tokens in sequences: a row for each piece; packing.sequences gives the sequences themselves."""
    return packing.pack(packing.pieces(docs, VOCABULARY))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None
"""SQL can't express the classifier, the field or the packing."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the table documents, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
