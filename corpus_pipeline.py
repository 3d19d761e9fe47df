"""A corpus pipeline of five stages; each one's rows are written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import language_id, near_duplicates, packing, quality, secrets
from lexloom.llm.common import stored, table
from lexloom.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a probable language; null and empty texts go, an empty table stays empty."""
    return language_id.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality verdict; null and very short texts fail it."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; rows with a null id all stay."""
    return near_duplicates.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, and n_chars with them; null texts stay null."""
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null text has its end id alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("near_duplicates", one_of_each_group),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Training, grouping and tokenising are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
