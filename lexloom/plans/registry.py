"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lexicon_queries, record_queries, text_queries

PARTS = (text_queries, lexicon_queries, record_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in PARTS for name, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in PARTS for name, q in part.oracle_sql().items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["dict_hit_by_length"](spark, sf_dir)
