"""Sharding by global byte-size prefix sums.

Rows are ranged by (doc_id, checksum, size); every range's total is summed once, the totals (one row a
range) give each range its offset, and a row's place on the byte axis decides its shard.  Cuts stand at
equal targets, so shards are contiguous in that order and their sizes differ by one document at most.

Defined cases: a null text has no bytes and counts 1; a null doc_id sorts first; equal rows share a range
boundary by a drawn number, so one id or text may hold any share of the rows; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of one range at most, on average.
RANGE_ROWS = 2_000_000


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.octet_length(body).cast("bigint") + 1).alias("size"),
            F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"),
        ),
        "shard-sizes",
    )
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slim.count() // RANGE_ROWS + 1)
    keys = ["doc_id", "text_crc32", "size", "draw"]
    ranged = stored(
        slim.withColumn("draw", F.rand(7)).repartitionByRange(ranges, *keys).withColumn("part", F.spark_partition_id()),
        "shard-ranges",
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_off"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_off"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*keys)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("end", F.sum("size").over(upto))
        .withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")  # one row a range
        .withColumn("row", F.col("row_off") + F.col("place") - 1)
        .withColumn("middle", 2 * (F.col("byte_off") + F.col("end")) - F.col("size"))
        .withColumn("shard", F.expr(f"least({shards - 1}, cast((middle * {shards}) div (2 * total) as int))"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # as many rows as shards
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
