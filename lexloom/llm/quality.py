"""Quality rules combined by weak supervision, in built-in functions only.

Each rule votes good (1), bad (-1) or abstains (0).  The rows of every combination of votes are counted
(at most 3 ** rules combinations, whatever the input), expectation-maximisation estimates from those
counts how often each rule is right about documents of each class, and a document's posterior
probability of being good decides.  A document over the hard limits of the base rule never passes.

Bad documents show one fault or another, seldom all of them: there is a class of bad documents for each
rule, the one whose fault that rule is made to see, and what the other rules say about it is learned.  So
good votes of rules that a fault does not touch do not outvote the one that sees it.  All accuracies are
free; a rule that never meets another one's votes cannot be judged by counts and stays near its prior.

Defined cases: a null or empty text has no words and fails the base rule; an empty table gives an empty
result with the prior accuracies; repeated rows get equal results; a text of any length is counted with
full 64-bit hashes; other columns, whatever their names, are not read and pass ``keep_good`` as they are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, added, stored, with_row, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: (name, column that measures, votes good up to, votes bad from, whether large is bad).
RULES = (
    ("length", "n_words", 50, 9, False),
    ("symbols", "symbols_per_word", 0.02, 0.2, True),
    ("lines", "dup_line_share", 0.0, 0.3, True),
    ("repeats", "repeat_share", 0.02, 0.15, True),
    ("word_size", "odd_word_size", 1.0, 4.0, True),
    ("shouting", "caps_share", 0.12, 0.5, True),
)
EM_ROUNDS, PRIOR_GOOD, PRIOR_WEIGHT = 200, 0.8, 20.0
#: How often a rule that votes is expected to vote good, on documents without its fault and with it.
VOTES_GOOD = (0.99, 0.02)
KEEP_FROM = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _joined(left: Column, right: Column, step: int) -> Column:
    """Hashes of each left hash with the right one ``step`` places on (past the end: of the left alone)."""
    return F.zip_with(left, F.slice(right, step + 1, F.size(right)), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rule and the capital letters of each text.

    Repeats within a text are found by sorting its window hashes with their places and comparing
    neighbours: linear memory, no pair loops.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__text", text)
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACE_CHARS))) > 0)
    out = (
        out.withColumn("__strings", words_of(text))
        .withColumn("__words", F.transform("__strings", lambda w: F.xxhash64(w)))
        .withColumn("__lines", F.transform(lines, lambda x: F.xxhash64(x)))
        .withColumn("n_words", F.size("__words").cast("bigint"))
        .withColumn("word_chars", F.aggregate("__strings", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint"))
        .withColumn("n_caps", F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
    )
    w = F.col("__words")
    out = out.withColumn("__pairs", _joined(w, w, 1)).withColumn("__fours", _joined(F.col("__pairs"), F.col("__pairs"), 2))
    hashes = _joined(F.col("__fours"), w, 4)
    placed = F.transform(F.col("__hash"), lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:bigint>>")
    out = (
        out.withColumn("__hash", F.slice(hashes, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))))
        .withColumn("__again", F.size(F.array_distinct("__hash")) < F.size("__hash"))
        .withColumn("__placed", F.when(F.col("__again"), F.sort_array(placed)).otherwise(none))
    )
    p = F.col("__placed")

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(x["h"] == F.get(p, i)["h"], F.lit(False))

    twice = F.filter(p, lambda x, i: same(x, i + 1) | same(x, i - 1))
    out = out.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.col("__at"),
        F.struct(F.lit(-WINDOW).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW).cast("bigint"), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return out.withColumn("n_repeat_words", covered).drop(
        "__text", "__strings", "__words", "__pairs", "__fours", "__lines", "__hash", "__again", "__placed", "__at"
    )


def _signals(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        df.withColumn("symbols_per_word", F.col("n_symbols") / words)
        .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
        .withColumn("repeat_share", F.col("n_repeat_words") / words)
        .withColumn("odd_word_size", F.abs(F.col("word_chars") / words - 5.5))
        .withColumn("caps_share", F.col("n_caps") / F.greatest(F.col("word_chars"), F.lit(1)))
    )


def _vote(column: str, good: float, bad: float, large_is_bad: bool) -> Column:
    x = F.col(column)
    is_good, is_bad = (x <= good, x >= bad) if large_is_bad else (x >= good, x <= bad)
    return F.when(is_bad, -1).when(is_good, 1).otherwise(0)


def voted(df: DataFrame) -> DataFrame:
    """The measured rows with ``base_failed`` and one ``vote_<rule>`` column for each rule."""
    df = _signals(df)
    for name, *rule in RULES:
        df = df.withColumn(f"vote_{name}", _vote(*rule))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


#: The share of each class, and the probability that each rule votes good on it where it votes: the first class is good.
Model = tuple[np.ndarray, np.ndarray]


def prior(rules: int = len(RULES)) -> Model:
    """Good documents, and one class of bad ones for each rule."""
    usual, faulty = VOTES_GOOD
    votes = np.full((rules + 1, rules), usual)
    votes[np.arange(rules) + 1, np.arange(rules)] = faulty
    return np.array([PRIOR_GOOD] + [(1 - PRIOR_GOOD) / rules] * rules), votes


def estimate(patterns: list[tuple[tuple[int, ...], int]], start: Model | None = None) -> Model:
    """Shares of the classes and the rules' votes on each, by EM from ``start``, which counts as PRIOR_WEIGHT rows a class.

    ``patterns``: every combination of votes that occurs, with its number of rows.  An abstention says nothing.
    """
    start = prior() if start is None else start
    share, good = start
    votes = np.array([v for v, _ in patterns]).reshape(-1, good.shape[1])
    n = np.array([c for _, c in patterns], float)
    for _ in range(EM_ROUNDS if len(patterns) else 0):
        mass = _classes(votes, share, good) * n[:, None]
        up, all_ = mass.T @ (votes > 0), mass.T @ (votes != 0)
        share = (mass.sum(0) + PRIOR_WEIGHT * start[0]) / (n.sum() + PRIOR_WEIGHT)
        good = (up + PRIOR_WEIGHT * start[1]) / (all_ + PRIOR_WEIGHT)
    return share, good


def _classes(votes: np.ndarray, share: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Probability of each class for each combination of votes."""
    odds = np.log(share) + (votes > 0) @ np.log(good).T + (votes < 0) @ np.log1p(-good).T
    p = np.exp(odds - odds.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def judged(df: DataFrame) -> DataFrame:
    """``df`` (rows with votes) with ``quality`` and ``kept``.

    Only the counts of vote combinations reach the driver: at most 3 ** len(RULES) rows.
    """
    names = [f"vote_{r[0]}" for r in RULES]
    counts = df.groupBy(*names).count().collect()
    share, good = estimate(sorted((tuple(r[v] for v in names), r["count"]) for r in counts))
    against = F.lit(0.0)
    for k in range(1, len(share)):
        odds = F.lit(math.log(share[k] / share[0]))
        for j, v in enumerate(names):
            up, down = (float(np.log(x[k, j] / x[0, j])) for x in (good, 1 - good))
            odds = odds + F.when(F.col(v) > 0, F.lit(up)).when(F.col(v) < 0, F.lit(down)).otherwise(F.lit(0.0))
        against = against + F.exp(odds)
    return df.withColumn("quality", 1 / (1 + against)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def _with_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("n_lines", F.size(F.split(text, "\n", -1)))


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: its counts and the verdict."""
    slim = measures(_with_lines(docs.select("doc_id", "text"))).drop("text")
    out = judged(stored(voted(slim), "quality-votes"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns as they were.

    The rows are written once with their votes, so that no text is measured twice.
    """
    own = with_row(docs, "text").withColumnRenamed("__text", "text")
    votes = voted(measures(_with_lines(own))).drop("text")
    return added(judged(stored(votes, "quality-docs")).filter("kept"), docs)
