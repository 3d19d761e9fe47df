"""Annotation of a stream of documents.

Stateless steps (normalising, tokens, joins with the static lexicon) run as they stand on a streaming
DataFrame; steps that need whole documents run on each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text
from ..operators.annotate import annotate
from ..sources.lexicon import Lexicon


def token_hits(stream: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, w, hit for every token of a stream: a stream-static join."""
    tokens = stream.select("doc_id", F.explode(text.letters(F.col("text"))).alias("w"))
    known = heads.select(F.col("headword").alias("w"), F.lit(True).alias("hit")).distinct()
    return tokens.join(known, "w", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def windowed_hits(stream: DataFrame, heads: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Tokens and hits of each time window; rows that are too late are dropped by the watermark."""
    tokens = stream.withWatermark(time, late).select(time, F.explode(text.letters(F.col("text"))).alias("w"))
    known = heads.select(F.col("headword").alias("w"), F.lit(1).alias("hit")).distinct()
    joined = tokens.join(known, "w", "left")
    return joined.groupBy(F.window(time, window).alias("window")).agg(F.count("*").alias("tokens"), F.count("hit").alias("hits"))


def annotate_to(stream: DataFrame, lexicon: Lexicon, path: str, checkpoint: str, mode: str = "detailed") -> DataStreamWriter:
    """Annotate each micro-batch and write it; a repeated batch overwrites its own folder, so none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch, lexicon, mode).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
