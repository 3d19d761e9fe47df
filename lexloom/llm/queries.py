"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language_id, licences, near_duplicates, nearest, packing, personal_data, quality, secrets, sharding
from .common import table



def vocabulary(name: str) -> str:
    """Where the public vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": lambda spark, d: licences.digest(table(spark, d, "documents")),
        "op2_sharding": lambda spark, d: sharding.shard_by_bytes(table(spark, d, "documents")),
        "op3_personal_data": lambda spark, d: personal_data.digest(table(spark, d, "documents")),
        "op4_near_duplicates": lambda spark, d: near_duplicates.group(table(spark, d, "documents")),
        "op5_bpe_round_trip": lambda spark, d: bpe.round_trips(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json")),
        "op6_best_fit_packing": lambda spark, d: packing.pack(table(spark, d, "documents"), vocabulary("word_bpe_49k.json")),
        "op7_nearest_neighbours": lambda spark, d: nearest.search(table(spark, d, "embeddings")),
        "op8_language_id": lambda spark, d: language_id.digest(table(spark, d, "documents")),
        "op9_quality_rules": lambda spark, d: quality.digest(table(spark, d, "documents")),
        "op10_secret_scan": lambda spark, d: secrets.digest(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licences.sql(),
        "op4_near_duplicates": near_duplicates.sql(),
        "op10_secret_scan": secrets.sql(),
    }
