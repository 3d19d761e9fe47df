"""Ordered candidates of a surface form, so that a recursive search becomes one join.

The order in which respellings and stripped prefixes are tried does not depend on lookups, but for the
first hit that ends the search: each word gets its ranked list of candidates, all are joined with the
index at once, and the least rank that hits wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import rules

SHORT_CIRCUIT = ("api", "āpi")


def closure(finals: dict[str, list[str]]) -> list[tuple[str, str, int]]:
    """(last character, replacement, rank): all that replacing finals again and again leads to, in search order."""
    out = []
    for lhs in finals:
        seen, found = {lhs}, []

        def visit(end: str, seen=seen, found=found) -> None:
            for rhs in finals.get(end[-1], []):
                new = end[:-1] + rhs
                if new not in seen and len(new) < 8:
                    seen.add(new)
                    found.append(new)
                    visit(new)

        visit(lhs)
        out += [(lhs, rhs, i + 1) for i, rhs in enumerate(found)]
    return out


def search_order(word: str, finals=None, sam=None, prefixes=None) -> list[tuple[str, tuple[str, ...]]]:
    """(candidate, stripped prefixes) in the order of the search, each candidate once.

    Depth first: the word, its respelled finals, its respelled first nasal, and then what is left behind
    each prefix, in turn.  A candidate that failed once fails always, so it is listed once: the search ends by
    itself, if no chain of respellings lengthens a word for ever.
    """
    finals = rules.FINALS if finals is None else finals
    sam = rules.SAM if sam is None else sam
    prefixes = rules.PREFIXES if prefixes is None else prefixes
    out: dict[str, tuple[str, ...]] = {}
    stack: list[tuple[str, tuple[str, ...]]] = [(word, ())]
    while stack:
        w, path = stack.pop()
        if not w or w in out:
            continue
        out[w] = path
        after = [(w[:-1] + r, path) for r in finals.get(w[-1], [])]
        if w[:3] in sam:
            after.append((sam[w[:3]] + w[3:], path))
        after += [(w[len(p) :], (*path, p)) for p in prefixes if w.startswith(p) and len(w) > len(p)]
        stack += after[::-1]
    return list(out.items())


_LISTED = T.ArrayType(
    T.StructType().add("rank", T.IntegerType()).add("cand", T.StringType()).add("path", T.ArrayType(T.StringType()))
)


@pandas_udf(_LISTED)
def candidates(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(
            lambda w: [{"rank": i, "cand": c, "path": list(p)} for i, (c, p) in enumerate(search_order(w))] if w else []
        )


def final_variants(words: DataFrame, finals: DataFrame) -> DataFrame:
    """w, rank, cand: the word at rank 0 and its respelled finals; ``finals`` is the closed relation (lhs, rhs, rank)."""
    own = words.select("w", F.lit(0).alias("rank"), F.col("w").alias("cand"))
    last = words.withColumn("lhs", F.right("w", F.lit(1)))
    more = last.join(finals, "lhs").select("w", "rank", F.concat(F.expr("left(w, length(w) - 1)"), "rhs").alias("cand"))
    return own.unionByName(more)


def _longest(relation: DataFrame, column: str):
    """The greatest length in a column, 1 at least, as a scalar subquery."""
    return relation.agg(F.greatest(F.coalesce(F.max(F.length(column)), F.lit(1)), F.lit(1))).scalar()


def prefix_strip(words: DataFrame, prefixes: DataFrame) -> DataFrame:
    """w, ord, prefix, rest: each prefix (relation prefix, ord) that leaves something.

    Joined by equality on the first characters, for each length of prefix.
    """
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.length("w") - 1, _longest(prefixes, "prefix"))))
    begins = words.filter(F.length("w") > 1).select("w", sizes.alias("n")).select("w", F.expr("left(w, n)").alias("prefix"))
    keyed = begins.join(prefixes, "prefix")
    return keyed.select("w", "ord", "prefix", F.expr("substring(w, length(prefix) + 1)").alias("rest"))


def first_hit(cands: DataFrame, heads: DataFrame) -> DataFrame:
    """w, rank, cand (and more columns of the candidates): the least rank whose candidate is a key of ``heads``."""
    hits = cands.join(heads.select(F.col("headword").alias("cand")).distinct(), "cand")
    return hits.groupBy("w").agg(F.min_by(F.struct(*[c for c in cands.columns if c != "w"]), "rank").alias("x")).select("w", "x.*")


def root_cascade(words: DataFrame, heads: DataFrame) -> DataFrame:
    """w, rank, cand, path: the full search order against a relation with the column headword."""
    listed = words.select("w", F.explode(candidates("w")).alias("x")).select("w", "x.*")
    return first_hit(listed, heads)


def abstract_bases(words: DataFrame, endings: DataFrame) -> DataFrame:
    """w, form: what is left of an abstract noun in -tva, with the noun's own case ending, to be analysed in its place.

    ``endings``: (suffix, ending).  The longest suffix counts; a base in -a takes the ending for its vowel,
    others stay as they are; the bare suffix is no abstract noun.
    """
    hits = _ending(words, endings)
    best = hits.groupBy("w").agg(F.max_by(F.struct("suffix", "ending"), F.length("suffix")).alias("x")).select("w", "x.*")
    base = F.expr("left(w, length(w) - length(suffix))")
    return best.select("w", F.when(base.endswith("a"), F.concat(F.expr("left(w, length(w) - length(suffix) - 1)"), "ending")).otherwise(base).alias("form"))


def _ending(words: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The words with every suffix (relation suffix, ...) that leaves something of them."""
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.length("w") - 1, _longest(suffixes, "suffix"))))
    ends = words.filter(F.length("w") > 1).select("w", sizes.alias("n")).select("w", F.expr("right(w, n)").alias("suffix"))
    return ends.join(suffixes, "suffix")


def suffix_strip(words: DataFrame, suffixes: DataFrame, heads: DataFrame) -> DataFrame:
    """w, base, suffix: the longest suffix (relation suffix) that leaves a headword."""
    cut = _ending(words, suffixes).withColumn("base", F.expr("left(w, length(w) - length(suffix))"))
    hits = cut.join(heads.select(F.col("headword").alias("base")).distinct(), "base")
    return hits.groupBy("w").agg(F.max_by(F.struct("base", "suffix"), F.length("suffix")).alias("x")).select("w", "x.*")


def rejoin_pairs(
    segments: DataFrame, heads: DataFrame, keys: list[str], joining: list[str] | None = None, spelled: dict | None = None
) -> DataFrame:
    """Segments that are joining prefixes, with the first joined spelling that is a headword.

    ``segments``: ``keys``, pos and w.
    """
    from pyspark.sql import Window

    joining = rules.JOINING if joining is None else joining
    spelled = rules.JOINED_SPELLINGS if spelled is None else spelled

    after = segments.withColumn("after", F.lead("w").over(Window.partitionBy(*keys).orderBy("pos")))
    spellings = F.create_map(*[x for p in joining for x in (F.lit(p), F.array(*[F.lit(s) for s in spelled.get(p, [p])]))])
    tries = after.filter(F.col("w").isin(joining) & F.col("after").isNotNull()).select(
        *keys, "pos", "w", "after", F.posexplode(F.try_element_at(spellings, F.col("w"))).alias("step", "spelling")
    )
    joined = tries.withColumn("joined", F.concat("spelling", "after")).join(heads.select(F.col("headword").alias("joined")).distinct(), "joined")
    best = joined.groupBy(*keys, "pos").agg(F.min_by("joined", "step").alias("joined"))
    return best


def inflect(segments: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (``keys``, pos, stem) with joining prefixes and their successors made one where that resolves, from left to right.

    ``forms``: the relation with the column headword that the search goes by.  Adds ``merged``.
    """
    from pyspark.sql import Window

    from .records import merge_runs

    after = segments.withColumn("after", F.lead("stem").over(Window.partitionBy(*keys).orderBy("pos")))
    spellings = F.create_map(*[x for p in rules.JOINING for x in (F.lit(p), F.array(*[F.lit(s) for s in rules.JOINED_SPELLINGS.get(p, [p])]))])
    tries = after.filter(F.col("stem").isin(rules.JOINING) & F.col("after").isNotNull())
    tries = tries.select(F.explode(F.transform(F.try_element_at(spellings, F.col("stem")), lambda x: F.concat(x, "after"))).alias("w")).distinct()
    known = root_cascade(tries, forms).select(F.col("w").alias("headword"))
    return merge_runs(segments, known, keys, rules.JOINING, spelled=rules.JOINED_SPELLINGS)
