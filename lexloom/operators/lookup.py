"""Lookups as joins: forms and paradigms, dictionary stages, wildcards.

Every operator takes distinct words (column ``w``) and joins them once with an index; nothing is looked
up word by word, and sides are broadcast only where the optimiser finds them small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

#: Characters of a pattern's literal beginning that find its candidates.
ANCHOR = 2


def form_hits(words: DataFrame, forms: DataFrame, kind: str, swap: bool = True) -> DataFrame:
    """w, form, model, stem, ord: index rows of each word; where it has none, of its m/ṃ respelling."""
    own = forms.filter(F.col("kind") == kind).select("form", "model", "stem", "ord")
    tries = words.select("w", F.col("w").alias("form"), F.lit(0).alias("step"))
    if swap:
        last = F.right("w", F.lit(1))
        other = F.when(last == "m", "ṃ").when(last == "ṃ", "m")
        swapped = words.select("w", F.concat(F.expr("left(w, length(w) - 1)"), other).alias("form"), F.lit(1).alias("step"))
        tries = tries.unionByName(swapped.filter("form is not null"))
    hits = tries.join(own, "form")
    return first_step(hits, ["w"], "step")


def first_step(hits: DataFrame, keys: list[str], step: str) -> DataFrame:
    """The hits of each key's first successful step."""
    least = Window.partitionBy(*keys)
    return hits.withColumn("__least", F.min(step).over(least)).filter(F.col(step) == F.col("__least")).drop("__least", step)


def without(words: Column, stopwords: list[str]) -> Column:
    """array<string>: the words that are no members of a short list, in order."""
    return F.filter(words, lambda w: ~w.isin(stopwords))


def prefixed_headwords(words: DataFrame, prefixes: DataFrame, heads: DataFrame) -> DataFrame:
    """w, prefix: words that are headwords (prefix empty), or one prefix (relation prefix, ord) and a headword; the first such prefix."""
    from .candidates import prefix_strip

    known = heads.select(F.col("headword").alias("rest")).distinct()
    own = words.select("w", F.lit(-1).alias("ord"), F.lit("").alias("prefix"), F.col("w").alias("rest"))
    tries = own.unionByName(prefix_strip(words, prefixes))
    return tries.join(known, "rest", "left_semi").groupBy("w").agg(F.min_by("prefix", "ord").alias("prefix"))


def refs_stem(refs: Column) -> Column:
    return F.regexp_extract(refs, r",(\p{L}+)", 1)


def decoded(cells: Column, form: Column, rows: list[str]) -> Column:
    """array<struct<row_label, number>>: the cells that equal ``form``; null without one."""
    labels = F.array(*[F.lit(x) for x in rows])
    numbers = F.array(*[F.lit(x) for x in rules.NUMBERS])
    found = F.filter(
        F.transform(
            cells,
            lambda c, i: F.when(
                c == form,
                F.struct(F.get(labels, F.floor(i / 3).cast("int")).alias("row_label"), F.get(numbers, i % 3).alias("number")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(found) > 0, found)


def analyses(hits: DataFrame, paradigms: DataFrame, kind: str, fused: bool = False) -> DataFrame:
    """w, stem, model, analyses, cells, ord: the hits with their paradigms; ``fused`` keeps the index's stem."""
    tables = paradigms.filter(F.col("kind") == kind).select("model", "stem", "refs", "cells")
    joined = hits.join(tables, ["stem", "model"])
    form = F.col("w") if fused else F.col("form")
    stem = F.col("stem") if fused else F.when(refs_stem(F.col("refs")) != "", refs_stem(F.col("refs"))).otherwise(F.col("stem"))
    labels = rules.NOUN_CASES if kind == "noun" else rules.PERSONS
    return joined.select("w", stem.alias("stem"), "model", decoded(F.col("cells"), form, labels).alias("analyses"), "cells", "ord")


def one_hit(hits: DataFrame, last: bool = True) -> DataFrame:
    """Only the last (or first) index hit of each word."""
    by = Window.partitionBy("w").orderBy(F.desc("ord") if last else F.asc("ord"), "model", "stem")
    return hits.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def expand_models(df: DataFrame, type_map: DataFrame) -> DataFrame:
    named = df.join(type_map, df["model"] == type_map["abbr"], "left")
    return named.withColumn("model", F.coalesce("description", "model")).drop("abbr", "description")


def root_lookup(words: DataFrame, forms: DataFrame, paradigms: DataFrame) -> DataFrame:
    """Noun analyses, then verb analyses, of every word; ``kind_ord`` keeps that order."""
    nouns = analyses(form_hits(words, forms, "noun"), paradigms, "noun").withColumn("kind_ord", F.lit(0))
    verbs = analyses(form_hits(words, forms, "verb", swap=False), paradigms, "verb").withColumn("kind_ord", F.lit(1))
    return nouns.unionByName(verbs)


def dict_stage(words: DataFrame, entries: DataFrame, stage: int) -> DataFrame:
    """Entries of each word: 1 equal, 2 but for the last character, 3 with one character more.

    Case does not count; words of one character are only looked up as they are.  Each stage is an equi-join
    on a derived key.
    """
    name, head = F.lower("w"), F.lower("headword")
    if stage == 1:
        left, right = words.withColumn("__k", name), entries.withColumn("__k", head)
    elif stage == 2:
        left = words.filter(F.length("w") > 1).withColumn("__k", F.concat_ws("|", F.length("w"), F.expr("left(lower(w), length(w) - 1)")))
        right = entries.withColumn("__k", F.concat_ws("|", F.length("headword"), F.expr("left(lower(headword), length(headword) - 1)")))
    else:
        left = words.filter(F.length("w") > 1).withColumn("__k", name)
        right = entries.withColumn("__k", F.expr("left(lower(headword), length(headword) - 1)"))
    on = ["__k", "dict_name"] if "dict_name" in words.columns else ["__k"]
    return left.join(right, on).drop("__k").withColumn("stage", F.lit(stage))


def dict_cascade(words: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of each word and dictionary at the first stage that has any."""
    stages = [dict_stage(words, entries, i) for i in (1, 2, 3)]
    found = stages[0].unionByName(stages[1]).unionByName(stages[2])
    least = Window.partitionBy("w", "dict_name")
    return found.withColumn("__least", F.min("stage").over(least)).filter("stage = __least").drop("__least")


def expanded_dicts(words: DataFrame, index: DataFrame, requested: list[str]) -> DataFrame:
    """w, dicts: the requested dictionaries, and the word's own where it is in none of them."""
    asked = F.array(*[F.lit(x) for x in requested])
    own = F.coalesce("dicts", F.array().cast("array<string>"))
    joined = words.join(index.withColumnRenamed("headword", "w"), "w", "left")
    dicts = F.when(F.size(F.array_intersect(asked, own)) == 0, F.array_union(asked, own)).otherwise(asked)
    return joined.select("w", dicts.alias("dicts"))


def wildcard(patterns: DataFrame, entries: DataFrame, head: str = "headword") -> DataFrame:
    """pattern x entry where the headword is like the pattern (``%`` and ``_``, case does not count).

    A pattern's literal beginning (up to ANCHOR characters) must equal the headword's: an equi-join finds
    candidates; only patterns that begin with a wildcard meet all headwords.
    """
    start = F.left(F.regexp_extract(F.lower("pattern"), "^[^%_]*", 0), F.lit(ANCHOR))
    keyed = patterns.withColumn("__k", start)
    begins = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(ANCHOR)), lambda n: F.left(F.lower(head), n)))
    return keyed.join(entries.withColumn("__k", F.explode(begins)), "__k").filter(F.expr(f"{head} ilike pattern")).drop("__k")


def starred(words: DataFrame, entries: DataFrame, compat: bool = False) -> DataFrame:
    """``w*``: entries that begin with w (``compat``: that equal it)."""
    asked = words.withColumn("stem", F.regexp_replace("w", r"\*+$", ""))
    if compat:
        return asked.join(entries, asked["stem"] == entries["headword"])
    return wildcard(asked.withColumn("pattern", F.concat("stem", F.lit("%"))), entries).drop("pattern")


def sam_variants(words: DataFrame, heads: DataFrame) -> DataFrame:
    """w, headword: the word itself where it is a headword, else its respelling where that is one."""
    swap = F.try_element_at(rules.literal_map(rules.SAM), F.left("w", F.lit(3)))
    tries = words.select("w", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("w").alias("headword")), F.struct(F.lit(1).alias("step"), F.concat(swap, F.expr("substring(w, 4)")).alias("headword")))).alias("x"))
    hits = tries.select("w", "x.*").filter("headword is not null").join(heads.select("headword").distinct(), "headword")
    return first_step(hits, ["w"], "step")


def dict_search(words: DataFrame, entries: DataFrame, requested: list[str]) -> DataFrame:
    """One row a word and entry found (or one with found = false): dictionaries expanded, stages tried."""
    from ..sources.lexicon import headword_index

    wanted = expanded_dicts(words, headword_index(entries), requested).select("w", F.explode("dicts").alias("dict_name"))
    found = dict_cascade(wanted, entries)
    return words.join(found, "w", "left").withColumn("found", F.col("headword").isNotNull())


def grouped_bodies(found: DataFrame) -> DataFrame:
    """w, dict_name, headword, bodies: the bodies of each headword, in their order."""
    rows = F.array_sort(F.collect_list(F.struct("body_pos", "body")))
    return found.groupBy("w", "dict_name", "headword").agg(F.transform(rows, lambda x: x["body"]).alias("bodies"))


def first_components(found: DataFrame) -> DataFrame:
    """w, components: the first that is not empty, over dictionaries in order."""
    full = found.filter("components is not null and components <> ''")
    return full.groupBy("w").agg(F.min_by("components", F.struct("dict_name", "headword", "body_pos")).alias("components"))
