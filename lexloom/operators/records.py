"""Ordered record rewriting and output modes, as windows over (keys, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources.stored import stored


#: Preverbs that the clean-up merges, and all stems that it drops, merges or passes over.
MERGED = ["sam", "anu", "ava", "duḥ"]
CLEANED = sorted({*rules.FILTERED, *MERGED, *(s for own in rules.SKIPPED.values() for s in own)})


def drop_repeated(records: DataFrame, keys: list[str], listed: list[str] | None = None) -> DataFrame:
    """Without records whose stem is one of ``listed`` and equals the stem before."""
    before = F.lag("stem").over(Window.partitionBy(*keys).orderBy("pos"))
    again = (F.col("stem") == before) & F.col("stem").isin(listed or rules.FILTERED)
    return records.withColumn("__again", F.coalesce(again, F.lit(False))).filter("not __again").drop("__again")


def merge_runs(
    records: DataFrame,
    heads: DataFrame,
    keys: list[str],
    prefixes: list[str],
    skipped: dict[str, list[str]] | None = None,
    spelled: dict[str, list[str]] | None = None,
    unless: list[str] | None = None,
    only: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Records where a prefix and the stem after it form a headword become one, from left to right.

    Behind a prefix stems of its list in ``skipped`` are passed over; its spellings in ``spelled`` are tried in
    turn; a next stem that is one of ``unless`` is not joined, and a prefix in ``only`` joins no others than its list.
    ``records`` is read twice, so it should be a stored table.  A record that a merge consumed starts none.
    """
    by = Window.partitionBy(*keys).orderBy("pos")
    # Backwards, what follows is what came before: frames that end at a row grow with it, those that begin there are read anew for each row.
    later = Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(by)
    ahead = records.withColumn("__i", place).withColumn("__next", F.lead("stem").over(by)).withColumn("__j", F.col("__i") + 1)
    for prefix, own in (skipped or {}).items():
        other = F.when(~F.col("stem").isin(own), F.struct("stem", F.col("__i").alias("i")))
        next_other = F.last(other, ignorenulls=True).over(later)
        ahead = ahead.withColumn("__x", F.when(F.col("stem") == prefix, next_other))
        ahead = ahead.withColumn("__next", F.when(F.col("stem") == prefix, F.col("__x")["stem"]).otherwise(F.col("__next")))
        ahead = ahead.withColumn("__j", F.when(F.col("stem") == prefix, F.col("__x")["i"]).otherwise(F.col("__j"))).drop("__x")
    forms = F.create_map(*[x for p in prefixes for x in (F.lit(p), F.array(*[F.lit(f) for f in (spelled or {}).get(p, [p])]))])
    tries = ahead.filter(F.col("stem").isin(prefixes) & F.col("__next").isNotNull() & ~F.col("__next").isin(unless or []))
    for prefix, own in (only or {}).items():
        tries = tries.filter((F.col("stem") != prefix) | F.col("__next").isin(own))
    tries = tries.select(*keys, "__i", "__j", "__next", F.posexplode(F.try_element_at(forms, F.col("stem"))).alias("__step", "__form"))
    known = heads.select(F.col("headword").alias("__joined")).distinct()
    found = tries.withColumn("__joined", F.concat("__form", "__next")).join(known, "__joined")
    found = found.groupBy(*keys, "__i", "__j").agg(F.min_by("__joined", "__step").alias("__joined"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__j").alias("j"), F.col("__joined").alias("w"))))
    # Of spans that overlap the leftmost one counts: one pass over a row's spans, in order.
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,j:int,w:string>>").alias("out"))
    kept = F.aggregate(
        "__spans",
        state,
        lambda acc, x: F.when(x["i"] > acc["at"], F.struct(x["j"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    spans = found.groupBy(*keys).agg(listed.alias("__spans")).select(*keys, F.explode(kept).alias("__s"))
    named = [F.col(k).alias(f"__key{n}") for n, k in enumerate(keys)]
    spans = spans.select(*named, F.explode(F.sequence("__s.i", "__s.j")).alias("__at"), F.col("__s.i").alias("__head"), F.col("__s.w").alias("__w"))
    same = [F.col(k).eqNullSafe(F.col(f"__key{n}")) for n, k in enumerate(keys)]
    joined = ahead.join(spans, [*same, F.col("__i") == F.col("__at")], "left").select(*records.columns, "__i", "__head", "__w")
    out = joined.filter("__head is null or __head = __i").withColumn("merged", F.col("__head").isNotNull())
    return out.withColumn("stem", F.coalesce("__w", "stem")).drop("__i", "__head", "__w")


def cleaned(records: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """The clean-up of one reading each position: repeats of light words go, stems in -n give way, preverbs are merged.

    ``records``: keys, pos, surface, stem and more columns; adds ``replaced`` and ``merged``.
    """
    out = replace_n_stems(drop_repeated(records, keys), heads)
    return merge_runs(
        stored(out, "cleaned"), heads, keys, MERGED, rules.SKIPPED, rules.JOINED_SPELLINGS, rules.PREFIXES, {"duḥ": ["kha"]}
    )


def replace_n_stems(records: DataFrame, heads: DataFrame, ending: str = "n") -> DataFrame:
    """Stems with that ending give way to the surface form where that is another headword."""
    known = heads.select(F.col("headword").alias("surface"), F.lit(True).alias("__known")).distinct()
    joined = records.join(known, "surface", "left")
    swap = F.col("stem").endswith(ending) & (F.col("stem") != F.col("surface")) & F.col("__known").isNotNull()
    return joined.withColumn("replaced", F.coalesce(swap, F.lit(False))).withColumn(
        "stem", F.when(F.col("replaced"), F.col("surface")).otherwise(F.col("stem"))
    ).drop("__known")


def promote_exact(records: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """A dictionary record at rank 0 for surfaces that are headwords but not the stem of their first analysis."""
    first = records.groupBy(*keys, "surface").agg(F.min_by("stem", "rank").alias("stem"))
    known = heads.select(F.col("headword").alias("surface")).distinct()
    added = first.filter("stem <> surface").join(known, "surface").select(*keys, "surface", F.col("surface").alias("stem"), F.lit(0).alias("rank"))
    return records.select(*keys, "surface", "stem", "rank").unionByName(added)


def long_enough(records: DataFrame, least: int = 2) -> DataFrame:
    return records.filter(F.length("stem") >= least)


def islands(records: DataFrame, keys: list[str]) -> DataFrame:
    """The records with ``island``: a number for each run of equal surfaces."""
    by = Window.partitionBy(*keys).orderBy("pos", "rank")
    new = F.coalesce(F.lag("surface").over(by) != F.col("surface"), F.lit(True))
    return records.withColumn("__new", new.cast("int")).withColumn(
        "island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__new")


def extract_roots(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, island, stems: the distinct stems of each run, in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "rank", "stem")))
    return islands(records, keys).groupBy(*keys, "island").agg(F.array_distinct(F.transform(rows, lambda x: x["stem"])).alias("stems"))


def roots_text(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, roots: all runs as one line of text."""
    runs = extract_roots(records, keys)
    rows = F.array_sort(F.collect_list(F.struct("island", "stems")))
    return runs.groupBy(*keys).agg(text.format_roots(F.transform(rows, lambda x: x["stems"])).alias("roots"))


def parts_map(records: DataFrame) -> DataFrame:
    """stem, parts: the component parts of each stem's first record (by ``ord``)."""
    first = records.groupBy("stem").agg(F.min_by(F.struct("components"), "ord").alias("x"))
    return first.select("stem", text.component_parts(F.col("x.components")).alias("parts"))


def grouped_roots(records: DataFrame) -> DataFrame:
    """surface (``default`` where there is none), roots: the set of stems, sorted."""
    return records.groupBy(F.coalesce("surface", F.lit("default")).alias("surface")).agg(F.array_sort(F.collect_set("stem")).alias("roots"))
