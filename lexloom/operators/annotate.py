"""Annotation of documents: from text to records, in three output modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, translit
from ..sources.lexicon import Lexicon, headword_index
from ..sources.stored import stored
from . import candidates, lookup, records, segment

MODES = ("detailed", "roots", "parts")


def surface_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compat: bool = False, max_length: int | None = None
) -> DataFrame:
    """doc_id, pos, surface: the normalised words of each text, explicit splits taken apart.

    The whole text is read, unless ``max_length`` asks for its first characters only.
    """
    plain = translit.to_iast(F.col(text_col))
    clean = text.normalise(plain, compat) if max_length is None else text.preprocess(plain, max_length, compat)
    parts = F.flatten(F.transform(text.tokens(clean), text.explicit_parts))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("pos", "surface"))


def analyse(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """w, rank, stem, model, analyses, cells, path, source for each distinct word (column ``w``).

    First forms over the ordered candidates (all at once, one join), then headwords, then segments of
    what is left, joined with their preverbs and analysed in their turn; what nothing resolves gets a row with
    source ``miss``.  Analyses of stripped preverbs stand before that of what they left; a headword that is not
    its own first stem stands before all.  Work is on distinct words only, in stored tables beside the text.
    """
    fixed = words.select("w", F.explode(F.array_distinct(F.array(F.col("w"), text.fix_final(F.col("w"))))).alias("f"))
    again = F.array_compact(F.array(text.restored_sibilant(F.col("f"))))
    spelled = fixed.select("w", F.posexplode(F.concat(text.nasal_candidates(F.col("f")), again)).alias("o", "f"))
    listed = spelled.select("w", "o", F.explode(candidates.candidates("f")).alias("x")).select("w", "o", "x.*")
    forms = lexicon.form_index.select("form").distinct().select(F.col("form").alias("headword"))
    swapped = forms.select(F.regexp_replace("headword", "ṃ$", "m").alias("headword")).unionByName(
        forms.select(F.regexp_replace("headword", "m$", "ṃ").alias("headword"))
    )
    forms = stored(forms.unionByName(swapped).distinct(), "forms")
    order = listed.withColumn("rank", F.col("o").cast("bigint") * 2**32 + F.col("rank")).drop("o")
    hit = stored(candidates.first_hit(order, forms), "hits")

    def looked_up(df: DataFrame) -> DataFrame:
        """The analyses of the distinct words ``cand``."""
        found = lookup.root_lookup(df.select(F.col("cand").alias("w")).distinct(), lexicon.form_index, lexicon.paradigm)
        return lookup.expand_models(found, lexicon.type_map).withColumnRenamed("w", "cand")

    stripped = hit.select("w", "path", F.posexplode("path").alias("n", "p"))
    stripped = stripped.select("w", "path", "n", F.when(F.col("p") == "ud", "ut").otherwise(F.col("p")).alias("cand"))
    asked = hit.select("w", "path", F.size("path").alias("n"), "cand").unionByName(stripped)
    kind = F.when(F.col("kind_ord") == 0, "noun").otherwise("verb")
    fields = ["w", "stem", "model", "analyses", "cells", "path"]
    place = F.struct("n", "kind_ord", "ord", "model", "stem").alias("o")
    by_form = stored(asked.join(looked_up(asked), "cand").select(*fields, kind.alias("source"), place), "by-form")
    rest = words.join(by_form.select("w").distinct(), "w", "left_anti")
    heads = stored(lexicon.dict_entry.select("headword").distinct(), "heads")
    exact = rest.join(heads, rest["w"] == heads["headword"]).select("w", F.col("headword").alias("stem"))
    left = stored(rest.join(exact.select("w"), "w", "left_anti"), "unknown")
    cut = segment.segment_greedy(left, heads).filter(F.size("parts") > 0).select("w", F.posexplode("parts").alias("pos", "stem"))
    cut = stored(candidates.inflect(stored(cut, "segments"), forms, ["w"]), "joined").select("w", F.col("pos").alias("n"), F.col("stem").alias("cand"))
    resolved = candidates.root_cascade(cut.select(F.col("cand").alias("w")).distinct(), forms).select(F.col("w").alias("part"), "cand", "path")
    resolved = stored(resolved.join(looked_up(resolved), "cand").drop("cand").withColumnRenamed("part", "cand"), "parts")
    pieces = cut.join(resolved, "cand").select(*fields, F.lit("segment").alias("source"), place)
    bare = cut.join(resolved.select("cand").distinct(), "cand", "left_anti").withColumnRenamed("cand", "stem")
    missing = left.join(cut.select("w").distinct(), "w", "left_anti").select("w", F.col("w").alias("stem"))
    first = by_form.groupBy("w").agg(F.min_by("stem", "o").alias("stem")).filter("stem <> w")
    promoted = first.join(heads, F.col("w") == F.col("headword")).select("w", F.col("w").alias("stem"))

    def plain(df: DataFrame, source: str, n) -> DataFrame:
        blank = {c: F.lit(None).cast(by_form.schema[c].dataType) for c in ("model", "analyses", "cells", "path")}
        none = F.lit(0).cast("int")
        order_ = F.struct(n.cast("int").alias("n"), none.alias("kind_ord"), none.alias("ord"), F.lit("").alias("model"), F.col("stem"))
        return df.select("w", "stem", *[v.alias(k) for k, v in blank.items()], F.lit(source).alias("source"), order_.alias("o"))

    everything = (
        by_form.unionByName(plain(promoted, "dict", F.lit(-1)))
        .unionByName(plain(exact, "dict", F.lit(0)))
        .unionByName(pieces)
        .unionByName(plain(bare, "segment", F.col("n")))
        .unionByName(plain(missing, "miss", F.lit(0)))
    )
    ranked = everything.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy("o")))
    return ranked.drop("o")


def _by_clean_up(tokens: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens that the clean-up may rewrite by what stands beside them, and all others.

    It drops, passes over and merges only stems of a short list, and the record before or after them; so
    a token is of the first kind if it, or the one before or after it, may have such a stem.
    """
    listed = records.CLEANED
    some = known.filter(F.col("stem").isin(listed) | F.col("surface").isin(listed)).select("surface").distinct()
    around = F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1))
    near = tokens.join(some, "surface", "left_semi").select(F.col("doc_id").alias("__doc"), around.alias("__pos")).distinct()
    near = stored(near, "near")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("pos") == F.col("__pos"))
    return tokens.join(near, same, "left_semi"), tokens.join(near, same, "left_anti")


def annotate(
    docs: DataFrame, lexicon: Lexicon, mode: str = "detailed", dicts: list[str] | None = None, max_length: int | None = None, clean: bool = True
) -> DataFrame:
    """Records of all documents (columns doc_id, text), each read whole or up to ``max_length`` characters.

    detailed: a row an analysis, with dictionary entries where ``dicts`` asks for them; roots: one line
    of stems a document; parts: the component parts of each stem.  ``clean`` rewrites the records in order:
    repeated light words, stems in -n, preverbs before what they belong to.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    tokens = stored(surface_tokens(docs, max_length=max_length), "tokens")
    # Frequent words are analysed once: the join back is the only step that sees every token.
    known = analyse(stored(tokens.select(F.col("surface").alias("w")).distinct(), "words"), lexicon).withColumnRenamed("w", "surface")
    known = known.withColumn("stem", F.replace("stem", F.lit("-"), F.lit(""))).withColumn("found", F.col("source") != "miss")
    if mode != "detailed":
        known = known.select("surface", "stem", "rank", "source", "found")
    known = stored(known, "known")
    rows = tokens.join(known, "surface")
    if clean:
        heads = lexicon.dict_entry.select("headword").distinct()
        close, apart = _by_clean_up(tokens, known)
        placed = close.join(known, "surface").withColumn("pos", F.struct("pos", "rank"))
        new = records.cleaned(placed, heads, ["doc_id"]).withColumn("pos", F.col("pos")["pos"])
        alone = stored(records.replace_n_stems(known, heads).withColumn("merged", F.lit(False)), "alone")
        new = apart.join(alone, "surface").unionByName(new)
        changed = F.col("replaced") | F.col("merged")
        for c in {"model", "analyses", "cells"} & set(rows.columns):
            new = new.withColumn(c, F.when(~changed, F.col(c)))
        new = new.withColumn("source", F.when(changed, "dict").otherwise(F.col("source"))).withColumn("found", F.col("found") | changed)
        rows = new.select(*rows.columns)
    if mode == "roots":
        return records.roots_text(records.long_enough(rows), ["doc_id"])
    if mode == "parts":
        stems = rows.select(F.col("stem").alias("w")).distinct()
        entries = lookup.dict_stage(stems, lexicon.dict_entry, 1).withColumn("ord", F.struct("dict_name", "body_pos"))
        return records.parts_map(entries.withColumnRenamed("w", "stem"))
    if dicts:
        stems = rows.select(F.col("stem").alias("w")).distinct()
        entries = lookup.dict_search(stems, lexicon.dict_entry, [d.lower() for d in dicts])
        bodies = lookup.grouped_bodies(entries.filter("found"))
        nested = bodies.groupBy("w").agg(F.collect_list(F.struct("dict_name", "headword", "bodies")).alias("entries"))
        rows = rows.join(nested.withColumnRenamed("w", "stem"), "stem", "left")
    return rows


def dict_search(spark, words: list[str], lexicon: Lexicon, *dicts: str) -> DataFrame:
    """The entries of single words; wildcards (``%``, ``_``, a trailing ``*``) search the headwords."""
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    wild = rows.filter(F.col("w").rlike(r"[%_*]")).withColumn("pattern", F.replace("w", F.lit("*"), F.lit("%")))
    entries = lexicon.dict_entry
    if dicts:
        entries_asked = entries.filter(F.col("dict_name").isin([d.lower() for d in dicts]))
    else:
        entries_asked = entries
    asked = [d.lower() for d in dicts] or ["mw"]
    plain = lookup.dict_search(rows.filter(~F.col("w").rlike(r"[%_*]")), entries, asked)
    found = lookup.wildcard(wild, entries_asked).withColumn("stage", F.lit(1)).withColumn("found", F.lit(True))
    return plain.unionByName(found.select(plain.columns))


def register(spark) -> None:
    """SQL functions lex_truncate(t), lex_detect(t), lex_normalize(t), and lex_convert(text, source, target), the transliterator."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION lex_truncate(t STRING) RETURNS STRING RETURN {_sql_truncate()}")
    for name, made in (("lex_detect", text.detect_scheme), ("lex_normalize", text.normalise)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {_sql_of(spark, made)}")
    spark.udf.register("lex_convert", translit._convert)


def _sql_of(spark, made) -> str:
    """The SQL text of a column function of one text ``t``."""
    plan = spark.range(0).select(F.lit("").alias("t")).select(made(F.col("t")).alias("x"))
    return plan._jdf.queryExecution().analyzed().expressions().head().child().sql().replace("`", "")


def _sql_truncate(most: int = 100) -> str:
    head = f"left(t, {most})"
    return (
        f"CASE WHEN length(t) <= {most} THEN t WHEN instr(reverse({head}), ' ') > 0 "
        f"THEN left(t, {most} - instr(reverse({head}), ' ')) ELSE {head} END"
    )


__all__ = ["MODES", "analyse", "annotate", "dict_search", "headword_index", "register", "surface_tokens"]
