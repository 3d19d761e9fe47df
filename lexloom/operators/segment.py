"""Compound segmentation over a lattice of dictionary edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import rules, text

#: Least score of an accepted first segment, and of a whole split.
ACCEPT, ACCEPT_SPLIT = 0.6, 0.535
#: Most headwords that are sent to all executors.
MOST_SENT = 300_000


def first_score(first: Column, rest: Column, known: Column, rest_known: Column, base_known: Column) -> Column:
    """Score of cutting ``first`` off: headword, resolvable rest, both long enough; less for stray endings."""
    penalty = F.lit(0.0)
    for end, minus in rules.PENALTIES.items():
        penalty = F.when(first.endswith(end) & base_known, minus).otherwise(penalty)
    score = (
        F.when(known, 0.4 - penalty).otherwise(0.0)
        + F.when(rest_known, 0.4).otherwise(0.0)
        + F.when((F.length(first) >= 2) & (F.length(rest) >= 2), 0.2).otherwise(0.0)
    )
    return F.least(F.lit(1.0), score)


def cut_points(words: DataFrame, least: int = 2) -> DataFrame:
    """w, i, first, rest: every cut of each word."""
    cut = words.filter(F.length("w") > least).select("w", F.explode(F.sequence(F.lit(least), F.length("w"))).alias("i"))
    return cut.select("w", "i", F.expr("left(w, i)").alias("first"), F.expr("substring(w, i + 1)").alias("rest"))


def flagged(cuts: DataFrame, heads: DataFrame) -> DataFrame:
    """The cuts with known, rest_known and base_known: membership of their parts among the headwords."""
    keys = heads.select("headword").distinct()

    def flag(df: DataFrame, column: Column, name: str) -> DataFrame:
        own = keys.select(F.col("headword").alias("__h"), F.lit(True).alias(name))
        out = df.withColumn("__k", column)
        return out.join(own, out["__k"] == own["__h"], "left").drop("__k", "__h").withColumn(name, F.coalesce(name, F.lit(False)))

    out = flag(cuts, F.col("first"), "known")
    out = flag(out, F.col("rest"), "rest_known")
    return flag(out, F.expr("left(first, length(first) - 2)"), "base_known")


def best_prefix_split(words: DataFrame, heads: DataFrame) -> DataFrame:
    """w, first, rest, score: the best accepted cut of each word; ties go to the longer first part."""
    scored = flagged(cut_points(words), heads).withColumn(
        "score", F.round(first_score(F.col("first"), F.col("rest"), F.col("known"), F.col("rest_known"), F.col("base_known")), 6)
    )
    best = scored.groupBy("w").agg(F.max_by(F.struct("first", "rest", "score"), F.struct("score", F.length("first"))).alias("x"))
    return best.select("w", "x.*").filter(F.col("score") >= ACCEPT)


def longest_prefix(words: DataFrame, heads: DataFrame) -> DataFrame:
    """w, first: the longest headword that begins each word."""
    found = cut_points(words, 1).join(heads.select(F.col("headword").alias("first")).distinct(), "first")
    return found.groupBy("w").agg(F.max_by("first", F.length("first")).alias("first"))


def lattice(words: DataFrame, heads: DataFrame) -> DataFrame:
    """w, edges: array<struct<s, n, v>> of all pieces (two characters or more) that are headwords.

    A piece's last character may stand for another spelling; ``v`` is the headword.  One explode and one
    join serve all words; pieces are no longer than the longest headword, so they are linear in a word's length.
    """
    longest = heads.agg(F.coalesce(F.max(F.length("headword")), F.lit(0))).scalar()
    # A word is a few bytes, but its pieces are many: a small table would leave all of them to one task.
    words = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w")
    pieces = words.filter(F.length("w") >= 2).select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("s"))
    most = F.least(F.length("w") - F.col("s") + 1, longest)
    pieces = pieces.select("w", "s", F.explode(F.sequence(F.lit(2), F.greatest(most, F.lit(2)))).alias("n"))
    pieces = pieces.filter("s + n - 1 <= length(w)").withColumn("p", F.expr("substring(w, s, n)"))
    variants = F.create_map(*[x for k, vs in rules.VARIANTS.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    others = F.transform(
        F.coalesce(F.try_element_at(variants, F.right("p", F.lit(1))), F.array().cast("array<string>")),
        lambda v: F.concat(F.expr("left(p, length(p) - 1)"), v),
    )
    spelled = pieces.select("w", "s", "n", F.posexplode(F.array_distinct(F.concat(F.array("p"), others))).alias("o", "v"))
    known = heads.select(F.col("headword").alias("v")).distinct()
    # Pieces are many times the words: while headwords are few, they are sent to the pieces instead.
    known = F.broadcast(known) if known.limit(MOST_SENT + 1).count() <= MOST_SENT else known
    listed = F.array_sort(F.collect_list(F.struct("s", "n", "o", "v")))
    hits = spelled.join(known, "v").groupBy("w").agg(listed.alias("hits"))
    first = F.filter("hits", lambda e, i: (i == 0) | (F.get("hits", i - 1)["s"] != e["s"]) | (F.get("hits", i - 1)["n"] != e["n"]))
    return hits.select("w", F.transform(first, lambda e: F.struct(e["s"].alias("s"), e["n"].alias("n"), e["v"].alias("v"))).alias("edges"))


def greedy(word: Column, edges: Column) -> Column:
    """array<string>: longest pieces from left to right; a character that begins none is skipped."""
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        here = F.filter(edges, lambda e: e["s"] == i)
        best = F.get(F.reverse(here), 0)  # edges are sorted, so the last one here is the longest
        return F.when(
            (acc["at"] == i) & (F.size(here) > 0),
            F.struct((i + best["n"]).alias("at"), F.concat(acc["out"], F.array(best["v"])).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], F.when(acc["at"] == i, i + 1).otherwise(acc["at"])).alias("at"), acc["out"].alias("out")))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), state, step, lambda acc: acc["out"])


def segment_greedy(words: DataFrame, heads: DataFrame) -> DataFrame:
    """w, parts: adjacent repeats dropped; words without any piece are left out."""
    found = lattice(words, heads)
    return found.select("w", text.adjacent_distinct(greedy(F.col("w"), F.col("edges"))).alias("parts"))


@pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def best_paths(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Up to ten full splits of each word over its edges, fewest pieces first: a beam over positions."""
    for words, edges in batches:
        yield pd.Series([_paths(w, [] if e is None else list(e)) for w, e in zip(words, edges, strict=True)])


def _paths(word: str, edges: list[dict], beam: int = 10) -> list[list[str]]:
    at: list[list[tuple[str, ...]]] = [[] for _ in range(len(word) + 1)]
    at[0] = [()]
    by_start: dict[int, list[dict]] = {}
    for e in edges:
        by_start.setdefault(e["s"] - 1, []).append(e)
    for i in range(len(word)):
        at[i] = sorted(set(at[i]), key=lambda p: (len(p), p))[:beam]
        for e in by_start.get(i, []):
            at[i + e["n"]] += [(*p, e["v"]) for p in at[i]]
    return [list(p) for p in sorted(set(at[-1]), key=lambda p: (len(p), p))[:beam]]


def segment_nbest(words: DataFrame, heads: DataFrame) -> DataFrame:
    """w, rank, parts, score: the splits of each word by score; equal scores keep the beam's order."""
    from pyspark.sql import Window

    listed = lattice(words, heads).select("w", F.posexplode(best_paths("w", "edges")).alias("o", "parts"))
    scored = listed.withColumn("score", F.round(text.split_score(F.col("w"), F.col("parts")), 6))
    by = Window.partitionBy("w").orderBy(F.desc("score"), "o")
    return scored.select("w", F.row_number().over(by).alias("rank"), "parts", "score")


def hybrid(first: Column, first_value: Column, second: Column, second_value: Column) -> Column:
    """The first split where it is good enough, else the second if that scores strictly higher."""
    value = F.when(F.size(first) == 1, 0.0).otherwise(first_value)
    return F.when(value >= ACCEPT_SPLIT, first).when(second_value > value, second).otherwise(first)
