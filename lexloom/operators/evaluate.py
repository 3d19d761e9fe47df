"""Evaluation of predictions, and summaries of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def root_accuracy(cases: DataFrame) -> DataFrame:
    """cases (predicted, parts: array<string>; expected: array<array<string>>) with their best accuracy."""
    scores = F.transform("expected", lambda e: text.accuracy(F.col("predicted"), F.col("parts"), e))
    return cases.withColumn("accuracy", F.round(F.array_max(scores), 6))


def root_diff(cases: DataFrame) -> DataFrame:
    """The cases with missing and extra roots against one expected array, sorted."""
    return cases.withColumn("missing", F.array_sort(F.array_except("expected", "predicted"))).withColumn(
        "extra", F.array_sort(F.array_except("predicted", "expected"))
    )


def grouping_sets(cases: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and count over everything and over each of two columns alone, in one pass."""
    view = cases.select(*by, value)
    sets = ", ".join(["()", *[f"({c})" for c in by]])
    levels = ", ".join(f"{c}" for c in by)
    name = "__grouping_cases"
    view.createOrReplaceTempView(name)
    return cases.sparkSession.sql(
        f"SELECT {levels}, count(*) AS n, round(avg({value}), 6) AS mean FROM {name} GROUP BY GROUPING SETS ({sets})"
    )


def timing(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))


def category_stats(df: DataFrame, category: str, value: str, good: str) -> DataFrame:
    """Count, sum, mean and share of good rows of each category, and of all (null category)."""
    return df.rollup(category).agg(
        F.count("*").alias("n"),
        F.sum(value).cast("bigint").alias("total"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(100 * F.avg(F.col(good).cast("double")), 6).alias("percent"),
    )


def sample_per_group(df: DataFrame, group: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group, the same ones each time; hashed classes keep groups spread.

    Each of ``most`` hash classes of a group gives its row of least hash.
    """
    drawn = F.xxhash64(key, F.lit(seed))
    rows = df.groupBy(group, F.pmod(F.xxhash64(key), F.lit(most)).alias("__class")).agg(
        F.min_by(F.struct(*df.columns), drawn).alias("x")
    )
    return rows.select("x.*")


def compare_modes(whole: DataFrame, single: DataFrame, key: str) -> DataFrame:
    """key, n_whole, n_single, difference: pieces found for the whole line, and word by word."""
    a = whole.groupBy(key).agg(F.count("*").alias("n_whole"))
    b = single.groupBy(key).agg(F.count("*").alias("n_single"))
    both = a.join(b, key, "left").withColumn("n_single", F.coalesce("n_single", F.lit(0)))
    return both.withColumn("difference", F.abs(F.col("n_whole") - F.col("n_single")))


def attach_validations(results: DataFrame, validations: DataFrame, key: str, by: str) -> DataFrame:
    """``results`` with ``validated`` and ``validations``: the optional expert rows of each key, in the order of ``by``."""
    rows = F.array_sort(F.collect_list(F.struct(by, *[c for c in validations.columns if c not in (key, by)])))
    own = validations.groupBy(key).agg(rows.alias("validations"))
    return results.join(own, key, "left").withColumn("validated", F.col("validations").isNotNull())


def top_per_group(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    by = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)
