"""Queries on ordered records, evaluation and the whole annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import annotate, evaluate, model, records
from ..sources import lexicon
from .lexicon_queries import E, LETTERS, P, PREFIXES, entries, heads, tables
from .text_queries import T, docs, sql_in, sql_list, turns

LISTED = ["the", "of", "on", "and", "a", "de", "in"]
KEYS = ["conv_id", "turn"]
TURN = f"t AS (SELECT conv_id, turn, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS stem FROM (SELECT conv_id, turn, {LETTERS} AS l FROM conversations))"
BY = "(PARTITION BY conv_id, turn ORDER BY pos)"


def stems(spark, d):
    """conv_id, turn, pos, stem: the letter tokens of every turn."""
    return turns(spark, d).select(*KEYS, F.posexplode(text.letters(T())).alias("pos", "stem"))


def doubled(spark, d):
    """Tokens with each one said twice now and then, so that there is something to drop."""
    again = F.array_repeat("stem", F.when(F.length("stem") % 2 == 0, 2).otherwise(1))
    return stems(spark, d).select(*KEYS, "pos", F.posexplode(again).alias("q", "stem")).select(*KEYS, (2 * F.col("pos") + F.col("q")).alias("pos"), "stem")


DOUBLED = f"{TURN}, d AS (SELECT conv_id, turn, CAST(2 * pos + q AS INT) AS pos, stem FROM (SELECT *, unnest(CASE WHEN length(stem) % 2 = 0 THEN [0, 1] ELSE [0] END) AS q FROM t))"


def read(spark, d):
    """Analysed tokens: surface and stem, with a rank; stems are cut by one letter where that is a headword."""
    t = stems(spark, d).withColumnRenamed("stem", "surface")
    short = heads(spark, d).select(F.col("headword").alias("short"), F.lit(True).alias("known"))
    j = t.withColumn("short", F.expr("left(surface, length(surface) - 1)")).join(short, "short", "left")
    out = F.when(F.col("known"), F.array("short", "surface")).otherwise(F.array("surface"))
    return j.select(*KEYS, "pos", "surface", F.posexplode(out).alias("rank", "stem")).withColumn("rank", F.col("rank") + 1)


READ = f"""{E}, {TURN}, r0 AS (SELECT conv_id, turn, pos, stem AS surface, CASE WHEN left(stem, length(stem) - 1) IN (SELECT headword FROM heads) THEN [left(stem, length(stem) - 1), stem] ELSE [stem] END AS l FROM t),
rec AS (SELECT conv_id, turn, pos, surface, unnest(range(1, len(l) + 1)) AS rank, unnest(l) AS stem FROM r0)"""

MERGED = f"""WITH {E}, {TURN}, a AS (SELECT *, lead(stem) OVER {BY} AS nx FROM t), c AS (SELECT *, CASE WHEN stem IN {sql_in(PREFIXES)} AND stem || nx IN (SELECT headword FROM heads) THEN 1 ELSE 0 END AS can FROM a),
i AS (SELECT *, sum(1 - can) OVER {BY} AS isl FROM c), m AS (SELECT *, can = 1 AND sum(can) OVER (PARTITION BY conv_id, turn, isl ORDER BY pos) % 2 = 1 AS merges FROM i),
g AS (SELECT *, coalesce(lag(merges) OVER {BY}, false) AS gone FROM m) SELECT conv_id, turn, pos, CASE WHEN merges THEN stem || nx ELSE stem END AS stem, merges AS merged FROM g WHERE NOT gone"""

#: Fixture of preverbs, and of stems that may stand behind them.
SKIPPERS, PASSED = PREFIXES[:4], ["the", "of"]
#: (case, predicted, expected): worked examples of the accuracy formula.
CASES = [
    ("a", ["deva", "manuṣya"], ["deva", "manuṣya"]),
    ("b", ["deva", "nara"], ["deva", "manuṣya"]),
    ("c", ["sītā"], ["sīta"]),
    ("d", ["dharma", "artha", "kāma"], ["dharma", "artha", "kāma", "mokṣa"]),
    ("e", ["x"], ["citta", "vṛtti"]),
]


def cases(spark):
    return spark.createDataFrame(CASES, "name string, predicted array<string>, expected array<string>")


CASES_SQL = "cases(name, predicted, expected) AS (VALUES " + ", ".join(f"('{n}', {sql_list(p)}, {sql_list(e)})" for n, p, e in CASES) + ")"


def rated(spark, d):
    """doc_id, lang, quality, toxic, n_chars: labels where there are any."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return docs(spark, d).select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")


RATED = "rated AS (SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def small_lexicon(spark, d):
    forms, paradigm = tables(spark, d)
    return lexicon.Lexicon(
        forms, paradigm, entries(spark, d), spark.createDataFrame([("n0", "even"), ("n1", "odd")], "abbr string, description string"),
        spark.createDataFrame([("the",)], "word string"),
    )


def accuracy_query(spark, d):
    c = cases(spark).select("name", "predicted", F.array().cast("array<string>").alias("parts"), F.array("expected").alias("expected"))
    return evaluate.root_accuracy(c).select("name", "accuracy")


def queries():
    return {
        "dedup_filtered": lambda s, d: records.drop_repeated(doubled(s, d), KEYS, LISTED),
        "merge_prefix": lambda s, d: records.merge_runs(stems(s, d), heads(s, d), KEYS, PREFIXES),
        "merge_pair": lambda s, d: records.merge_runs(stems(s, d), s.createDataFrame([("ofthe",), ("inthe",)], "headword string"), KEYS, ["of", "in"]).filter("merged"),
        "merge_skipped": lambda s, d: records.merge_runs(doubled(s, d), heads(s, d), KEYS, SKIPPERS, {p: [p, *PASSED] for p in SKIPPERS}, {SKIPPERS[0]: [SKIPPERS[0][:1], SKIPPERS[0]]}, ["on"]).filter("merged").select(*KEYS, "pos", "stem"),
        "validation_attach": lambda s, d: evaluate.attach_validations(docs(s, d).select("doc_id", "lang"), s.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit("expert").alias("expert_id"), "quality"), "doc_id", "expert_id").select("doc_id", "validated", F.coalesce(F.size("validations"), F.lit(0)).alias("n")),
        "compound_source": lambda s, d: lexicon.compounds(docs(s, d).filter("lang is not null").select("doc_id", F.to_json(F.struct(F.create_map("lang", F.array(F.struct("text", F.col("source").alias("source_file")))).alias("compounds"))).alias("j")), "j"),
        "json_repair": lambda s, d: docs(s, d).select("doc_id", text.repaired_json(F.concat(F.lit('{"n": '), F.col("n_chars"), F.when(F.col("doc_id") % 2 == 0, "}").otherwise(', "t": "x')), "n long, t string")["n"].alias("n")),
        "nstem_replace": lambda s, d: records.replace_n_stems(read(s, d).drop("rank"), heads(s, d)).filter("replaced").select(*KEYS, "pos", "surface", "stem"),
        "promote_exact": lambda s, d: records.promote_exact(read(s, d), heads(s, d), [*KEYS, "pos"]).filter("rank = 0").select(*KEYS, "pos", "stem"),
        "min_len_filter": lambda s, d: records.long_enough(stems(s, d)),
        "extract_roots": lambda s, d: records.extract_roots(read(s, d), KEYS).select(*KEYS, F.col("island").cast("bigint").alias("island"), F.array_join("stems", "|").alias("stems")),
        "format_roots": lambda s, d: records.roots_text(read(s, d), KEYS),
        "parts_map": lambda s, d: records.parts_map(entries(s, d).withColumnRenamed("headword", "stem").withColumn("ord", F.struct("dict_name", "body_pos"))).select("stem", F.array_join("parts", ",").alias("parts")),
        "group_roots": lambda s, d: records.grouped_roots(read(s, d)).select("surface", F.array_join("roots", ",").alias("roots")),
        "root_accuracy": accuracy_query,
        "root_diff": lambda s, d: evaluate.root_diff(cases(s)).select("name", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra")),
        "accuracy_grouping_sets": lambda s, d: evaluate.grouping_sets(rated(s, d).withColumn("quality", F.col("quality").cast("string")), "n_chars", ["lang", "quality"]),
        "timing_stats": lambda s, d: evaluate.timing(docs(s, d), "n_chars"),
        "category_stats": lambda s, d: evaluate.category_stats(rated(s, d), "lang", "n_chars", "quality"),
        "category_counts": lambda s, d: docs(s, d).groupBy("lang").agg(F.count("*").alias("n")),
        "compare_modes": lambda s, d: evaluate.compare_modes(stems(s, d), stems(s, d).filter(F.length("stem") > 2), "conv_id"),
        "sample_per_group": lambda s, d: evaluate.sample_per_group(docs(s, d).select("doc_id", "lang"), "lang", "doc_id", 20),
        "json_text_extract": lambda s, d: lexicon.texts_in_json(s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit('{"a": [{"text": "x"}, {"b": {"text": "y"}}], "props": '), F.coalesce("props", F.lit("null")), F.lit("}")).alias("j")), "j"),
        "annotate_tokens": lambda s, d: annotate.annotate(docs(s, d), small_lexicon(s, d)).select("doc_id", "pos", "surface", "stem", "model", "source", "rank"),
        "annotate_roots": lambda s, d: annotate.annotate(docs(s, d), small_lexicon(s, d), "roots"),
        "annotate_sources": lambda s, d: annotate.annotate(docs(s, d), small_lexicon(s, d)).select("source").groupBy("source").agg(F.count("*").alias("n")),
        "model_segments": lambda s, d: model.segmented(docs(s, d).select("doc_id", "text"), lambda: lambda prompts: [p[2:].replace("e", "_") for p in prompts]),
        "lexicon_scan": lambda s, d: tables(s, d)[1].select("kind", "model", "stem", F.size("cells").alias("n")),
    }


def oracle_sql():
    acc = """round((len(list_intersect(expected, predicted)) + 0.5 * len(list_filter(expected, lambda e: NOT list_contains(predicted, e)
 AND list_contains(list_transform(predicted, lambda p: left(p, length(p) - 1) || translate(right(p, 1), 'āīūṝ', 'aiuṛ')), left(e, length(e) - 1) || translate(right(e, 1), 'āīūṝ', 'aiuṛ'))))) / len(expected), 6)"""
    isl = "isl AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id, turn ORDER BY pos, rank) AS island FROM (SELECT *, CASE WHEN lag(surface) OVER (PARTITION BY conv_id, turn ORDER BY pos, rank) = surface THEN 0 ELSE 1 END AS nw FROM rec))"
    runs = "fs AS (SELECT conv_id, turn, island, stem, min(pos * 10 + rank) AS o FROM isl GROUP BY ALL), runs AS (SELECT conv_id, turn, CAST(island AS BIGINT) AS island, list(stem ORDER BY o) AS l FROM fs GROUP BY ALL)"
    return {
        "dedup_filtered": f"WITH {DOUBLED}, l AS (SELECT *, lag(stem) OVER {BY} AS b FROM d) SELECT conv_id, turn, pos, stem FROM l WHERE NOT coalesce(b = stem AND stem IN {sql_in(LISTED)}, false)",
        "merge_prefix": MERGED,
        "merge_pair": f"SELECT * FROM ({MERGED.replace(f'stem IN {sql_in(PREFIXES)}', "stem IN ('of', 'in')").replace('(SELECT headword FROM heads)', "('ofthe', 'inthe')")}) WHERE merged",
        "validation_attach": "SELECT d.doc_id, count(l.doc_id) > 0 AS validated, CAST(count(l.doc_id) AS INT) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id",
        "compound_source": "SELECT doc_id, lang AS category, 0 AS idx, text, source AS source_file FROM documents WHERE lang IS NOT NULL",
        "json_repair": "SELECT doc_id, n_chars AS n FROM documents",
        "nstem_replace": f"WITH {READ} SELECT conv_id, turn, pos, surface, surface AS stem FROM rec WHERE stem LIKE '%n' AND stem <> surface AND surface IN (SELECT headword FROM heads)",
        "promote_exact": f"WITH {READ}, f AS (SELECT * FROM rec WHERE rank = 1 AND stem <> surface AND surface IN (SELECT headword FROM heads)) SELECT conv_id, turn, pos, surface AS stem FROM f",
        "min_len_filter": f"WITH {TURN} SELECT * FROM t WHERE length(stem) > 1",
        "extract_roots": f"WITH {READ}, {isl}, {runs} SELECT conv_id, turn, island, array_to_string(l, '|') AS stems FROM runs",
        "format_roots": f"WITH {READ}, {isl}, {runs} SELECT conv_id, turn, string_agg(CASE WHEN len(l) > 1 THEN '(' || array_to_string(l, ' | ') || ')' ELSE l[1] END, ' ' ORDER BY island) AS roots FROM runs GROUP BY ALL",
        "parts_map": f"WITH {E}, f AS (SELECT headword AS stem, min_by(struct_pack(c := components), struct_pack(a := dict_name, b := body_pos)) AS x FROM entry GROUP BY headword) SELECT stem, coalesce(array_to_string(list_distinct_ordered, ','), '') AS parts FROM (SELECT stem, CASE WHEN x.c IS NULL THEN [] WHEN split_part(x.c, '-', 2) IN ('', split_part(x.c, '-', 1)) THEN [split_part(x.c, '-', 1)] ELSE string_split(x.c, '-') END AS list_distinct_ordered FROM f)",
        "group_roots": f"WITH {READ} SELECT surface, array_to_string(list_sort(list(DISTINCT stem)), ',') AS roots FROM rec GROUP BY surface",
        "root_accuracy": f"WITH {CASES_SQL} SELECT name, {acc} AS accuracy FROM cases",
        "root_diff": f"WITH {CASES_SQL} SELECT name, array_to_string(list_sort(list_filter(expected, lambda e: NOT list_contains(predicted, e))), ',') AS missing, array_to_string(list_sort(list_filter(predicted, lambda e: NOT list_contains(expected, e))), ',') AS extra FROM cases",
        "accuracy_grouping_sets": f"WITH {RATED} SELECT lang, CAST(quality AS VARCHAR) AS quality, count(*) AS n, round(avg(n_chars), 6) AS mean FROM rated GROUP BY GROUPING SETS ((), (lang), (quality))",
        "timing_stats": "SELECT round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents",
        "category_stats": f"WITH {RATED} SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, round(100 * avg(quality), 6) AS percent FROM rated GROUP BY ROLLUP (lang)",
        "category_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
        "compare_modes": f"WITH {TURN}, a AS (SELECT conv_id, count(*) AS n_whole, count(*) FILTER (length(stem) > 2) AS n_single FROM t GROUP BY conv_id) SELECT *, abs(n_whole - n_single) AS difference FROM a",
        "lexicon_scan": f"WITH {P} SELECT kind, model, stem, CAST(len(cells) AS INT) AS n FROM paradigm",
    }

