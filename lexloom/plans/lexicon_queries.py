"""Queries on lookups, candidates and segmentation.

The lexicon is derived from the test tables: headwords are the distinct words of ``benchmark`` and of
the two roles of ``conversations``; forms are stems with inline endings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text, translit
from ..operators import candidates, lookup, segment
from ..sources import lexicon
from ..sources.stored import stored_once
from .text_queries import STOP, T, W, WORDS, docs, sql_in, turns, words

#: Endings of the fixture paradigms: 24 nominal cells with repeats, and 9 verbal ones.
NOUN = "||en|er|es|s|e|ed|ing|ly|re|ti|nd|th|||ent|ion|he|an|at|in|ha".split("|")
NOUN = (NOUN + [""] * 24)[:24]
VERB = "s|ed|ing|er|est|ly|en|es|".split("|")
FINALS = {"s": ["d", "t"], "t": ["d"], "d": ["t", "n"], "n": ["m", "r"], "e": ["a"]}
PREFIXES = ["re", "un", "an", "th", "in", "de", "on", "er"]
PATTERNS = ["a%", "th%on", "%tion", "in__", "%EA%"]
LETTERS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')"


def entries(spark, d):
    """dict_name, headword, components, body, body_pos: made once a session."""
    return stored_once(spark, "fixture-entries", d, lambda: _entries(spark, d))


def _entries(spark, d):
    bench = spark.read.parquet(f"{d}/benchmark.parquet").select(F.lit("bench").alias("dict_name"), F.col("item_id").alias("id"), F.explode(text.letters(T())).alias("headword"))
    conv = turns(spark, d).select(F.concat(F.lit("conv_"), "role").alias("dict_name"), F.col("conv_id").alias("id"), F.explode(text.letters(T())).alias("headword"))
    rows = bench.unionByName(conv).groupBy("dict_name", "headword").agg(F.min("id").cast("string").alias("lo"), F.max("id").cast("string").alias("hi"))
    parts = F.when(F.length("headword") % 2 == 0, F.concat(F.left("headword", F.lit(3)), F.lit("-"), F.expr("substring(headword, 4)")))
    return rows.select("dict_name", "headword", parts.alias("components"), F.posexplode(F.array_distinct(F.array("lo", "hi"))).alias("body_pos", "body"))


E = rf"""raw AS (SELECT 'bench' AS dict_name, item_id AS id, unnest({LETTERS}) AS headword FROM benchmark
 UNION ALL SELECT 'conv_' || role, conv_id, unnest({LETTERS}) FROM conversations),
agg AS (SELECT dict_name, headword, CAST(min(id) AS VARCHAR) AS lo, CAST(max(id) AS VARCHAR) AS hi FROM raw GROUP BY ALL),
entry AS (SELECT dict_name, headword, CASE WHEN length(headword) % 2 = 0 THEN left(headword, 3) || '-' || substr(headword, 4) END AS components,
 0 AS body_pos, lo AS body FROM agg UNION ALL SELECT dict_name, headword, CASE WHEN length(headword) % 2 = 0 THEN left(headword, 3) || '-' || substr(headword, 4) END, 1, hi FROM agg WHERE hi <> lo),
heads AS (SELECT DISTINCT headword FROM entry)"""
EW = f"WITH {E}, {WORDS}"


def heads(spark, d):
    return stored_once(spark, "fixture-heads", d, lambda: entries(spark, d).select("headword").distinct())


def bench_words(spark, d):
    return entries(spark, d).filter("dict_name = 'bench'").select(F.col("headword").alias("w")).distinct()


def asked(spark, d, *names):
    """Distinct document words, with the dictionaries that are searched."""
    return words(spark, d).withColumn("dict_name", F.explode(F.array(*[F.lit(n) for n in names or ("bench", "conv_user")])))


ASKED = "asked AS (SELECT w, unnest(['bench', 'conv_user']) AS dict_name FROM wordlist)"
STAGE = {
    1: "SELECT a.w, a.dict_name, headword, components, body, body_pos, 1 AS stage FROM asked a JOIN entry e ON a.dict_name = e.dict_name AND lower(headword) = lower(w)",
    2: "SELECT a.w, a.dict_name, headword, components, body, body_pos, 2 AS stage FROM asked a JOIN entry e ON a.dict_name = e.dict_name AND length(headword) = length(w) AND left(lower(headword), length(headword) - 1) = left(lower(w), length(w) - 1) WHERE length(w) > 1",
    3: "SELECT a.w, a.dict_name, headword, components, body, body_pos, 3 AS stage FROM asked a JOIN entry e ON a.dict_name = e.dict_name AND left(lower(headword), length(headword) - 1) = lower(w) WHERE length(w) > 1",
}
CASCADE = f"{EW}, {ASKED}, st AS ({STAGE[1]} UNION ALL {STAGE[2]} UNION ALL {STAGE[3]}), cas AS (SELECT * FROM st QUALIFY stage = min(stage) OVER (PARTITION BY w, dict_name))"


def tables(spark, d):
    """(form_index, paradigm) of the fixture, made once a session: stems of 4 to 8 letters for nouns, 5 to 7 for verbs."""
    paradigm = stored_once(spark, "fixture-paradigm", d, lambda: _paradigm(spark, d))
    return paradigm.select("kind", F.explode(F.array_distinct("cells")).alias("form"), "model", "stem", F.length("stem").alias("ord")), paradigm


def _paradigm(spark, d):
    w = bench_words(spark, d)
    out = []
    for kind, lo, hi, endings in (("noun", 4, 8, NOUN), ("verb", 5, 7, VERB)):
        stems = w.filter(F.length("w").between(lo, hi)).select(F.lit(kind).alias("kind"), F.concat(F.lit(kind[0]), (F.length("w") % 2).cast("string")).alias("model"), F.col("w").alias("stem"))
        cells = F.transform(F.array(*[F.lit(x) for x in endings]), lambda x: F.concat("stem", x))
        out.append(stems.select("kind", "model", "stem", F.concat(F.lit("1,"), "stem", F.lit(";2")).alias("refs"), cells.alias("cells")))
    return out[0].unionByName(out[1])


def _endings(xs):
    return "[" + ", ".join(f"stem || '{x}'" for x in xs) + "]"


P = f"""{E}, bw AS (SELECT DISTINCT headword AS w FROM entry WHERE dict_name = 'bench'),
paradigm AS (SELECT kind, model, stem, '1,' || stem || ';2' AS refs, cells FROM (
 SELECT 'noun' AS kind, 'n' || (length(w) % 2) AS model, w AS stem, {_endings(NOUN).replace("stem", "w")} AS cells FROM bw WHERE length(w) BETWEEN 4 AND 8
 UNION ALL SELECT 'verb', 'v' || (length(w) % 2), w, {_endings(VERB).replace("stem", "w")} FROM bw WHERE length(w) BETWEEN 5 AND 7)),
form AS (SELECT kind, unnest(list_distinct(cells)) AS form, model, stem, length(stem) AS ord FROM paradigm)"""
PW = f"WITH {P}, {WORDS}"


def decode_sql(kind, form):
    labels = "['" + "','".join(rules.NOUN_CASES if kind == "noun" else rules.PERSONS) + "']"
    return f"unnest(list_filter(list_transform(range(len(cells)), lambda i: CASE WHEN cells[i + 1] = {form} THEN ({labels})[i // 3 + 1] || '.' || (['Sg','Du','Pl'])[i % 3 + 1] END), lambda x: x IS NOT NULL)) AS label"


def shown(df):
    """Flat rows: one a label."""
    label = F.concat_ws(".", F.col("a.row_label"), F.col("a.number"))
    return df.select("w", "stem", "model", F.explode("analyses").alias("a")).select("w", "stem", "model", label.alias("label"))


def analysed(kind, fused=False, **pick):
    def run(spark, d):
        forms, paradigm = tables(spark, d)
        hits = lookup.form_hits(words(spark, d), forms, kind, swap=kind == "noun")
        if pick:
            hits = lookup.one_hit(hits, **pick)
        return shown(lookup.analyses(hits, paradigm, kind, fused))

    return run


def hits_sql(kind, swap=False, pick=""):
    tries = "SELECT w, w AS form, 0 AS step FROM wordlist"
    if swap:
        tries += " UNION ALL SELECT w, left(w, length(w) - 1) || CASE right(w, 1) WHEN 'm' THEN 'ṃ' ELSE 'm' END, 1 FROM wordlist WHERE right(w, 1) IN ('m', 'ṃ')"
    hits = f"SELECT w, f.form, model, stem, ord, step FROM ({tries}) t JOIN form f ON t.form = f.form AND kind = '{kind}' QUALIFY step = min(step) OVER (PARTITION BY w)"
    if pick:
        hits = f"SELECT * FROM ({hits}) QUALIFY row_number() OVER (PARTITION BY w ORDER BY ord {pick}, model, stem) = 1"
    return hits


def analysed_sql(kind, swap=False, pick=""):
    return f"{PW}, hits AS ({hits_sql(kind, swap, pick)}) SELECT w, stem, model, {decode_sql(kind, 'form')} FROM hits JOIN paradigm USING (stem, model)"


CLOSED = candidates.closure(FINALS)
CLOSED_SQL = "closed(lhs, rhs, rank) AS (VALUES " + ", ".join(f"('{a}', '{b}', {r})" for a, b, r in CLOSED) + ")"
VARIANTS = "SELECT w, 0 AS rank, w AS cand FROM wordlist UNION ALL SELECT w, rank, left(w, length(w) - 1) || rhs FROM wordlist JOIN closed ON right(w, 1) = lhs"
PREFIX_SQL = "prefix(prefix, ord) AS (VALUES " + ", ".join(f"('{p}', {i})" for i, p in enumerate(PREFIXES)) + ")"
STRIPPED = "SELECT w, ord, prefix, substr(w, length(prefix) + 1) AS rest FROM wordlist JOIN prefix ON starts_with(w, prefix) WHERE length(w) > length(prefix)"


def closed(spark):
    return spark.createDataFrame(CLOSED, "lhs string, rhs string, rank int")


def prefixes(spark):
    return spark.createDataFrame([(p, i) for i, p in enumerate(PREFIXES)], "prefix string, ord int")


def cascade(spark, d):
    """Finals first, then finals of what a prefix leaves."""
    w = words(spark, d)
    own = candidates.final_variants(w, closed(spark))
    rest = candidates.prefix_strip(w, prefixes(spark))
    left = candidates.final_variants(rest.select(F.col("rest").alias("w")).distinct(), closed(spark)).withColumnRenamed("w", "rest")
    more = rest.join(left, "rest").select("w", (100 * (F.col("ord") + 1) + F.col("rank")).alias("rank"), "cand")
    return candidates.first_hit(own.unionByName(more), heads(spark, d))


CASCADE_ROOT = f"""{EW}, {CLOSED_SQL}, {PREFIX_SQL}, own AS ({VARIANTS}), strip AS ({STRIPPED}),
more AS (SELECT w, 100 * (ord + 1) AS rank, rest AS cand FROM strip UNION ALL SELECT w, 100 * (ord + 1) + rank, left(rest, length(rest) - 1) || rhs FROM strip JOIN closed ON right(rest, 1) = lhs),
hit AS (SELECT w, rank, cand FROM (SELECT * FROM own UNION ALL SELECT * FROM more) JOIN heads ON cand = headword)
SELECT w, min(rank) AS rank, min_by(cand, rank) AS cand FROM hit GROUP BY w"""

CUTS = "cut AS (SELECT w, i, left(w, i) AS first, substr(w, i + 1) AS rest FROM (SELECT w, unnest(range(2, length(w) + 1)) AS i FROM wordlist WHERE length(w) > 2))"
SCORED = f"""{EW}, {CUTS}, fl AS (SELECT c.*, h1.headword IS NOT NULL AS known, h2.headword IS NOT NULL AS rest_known, h3.headword IS NOT NULL AS base_known FROM cut c
 LEFT JOIN heads h1 ON h1.headword = first LEFT JOIN heads h2 ON h2.headword = rest LEFT JOIN heads h3 ON h3.headword = left(first, length(first) - 2)),
sc AS (SELECT w, i, first, rest, round(least(1.0, CASE WHEN known THEN 0.4 - CASE WHEN first LIKE '%sa' AND base_known THEN 0.3 WHEN first LIKE '%ka' AND base_known THEN 0.5 ELSE 0.0 END ELSE 0.0 END
 + CASE WHEN rest_known THEN 0.4 ELSE 0.0 END + CASE WHEN length(first) >= 2 AND length(rest) >= 2 THEN 0.2 ELSE 0.0 END), 6) AS score FROM fl)"""


def split_scores(spark, d):
    c = segment.flagged(segment.cut_points(words(spark, d)), heads(spark, d))
    score = segment.first_score(F.col("first"), F.col("rest"), F.col("known"), F.col("rest_known"), F.col("base_known"))
    return c.select("w", "i", F.round(score, 6).alias("score"))


def known_splits(spark, d):
    cuts = segment.cut_points(words(spark, d)).filter("rest <> ''")
    f = segment.flagged(cuts, heads(spark, d))
    return f.groupBy("w").agg(F.sum((F.col("known") & F.col("rest_known")).cast("int")).cast("bigint").alias("n_known"))


def flat_parts(df):
    return df.select("w", F.posexplode("parts").alias("n", "part"))


def chosen(spark, d):
    """Halves against the best prefix split, by score."""
    best = segment.best_prefix_split(words(spark, d), heads(spark, d)).filter("rest <> ''")
    half = F.array(F.expr("left(w, length(w) div 2)"), F.expr("substring(w, length(w) div 2 + 1)"))
    both = best.select("w", half.alias("a"), F.array("first", "rest").alias("b"))
    va, vb = (F.round(text.split_score(W(), F.col(c)), 6) for c in "ab")
    return both.select("w", F.array_join(segment.hybrid(F.col("a"), va, F.col("b"), vb), "+").alias("split"))


SUFFIXES = ["ing", "tion", "ed", "er", "ly", "nd"]


def rejoined(spark, d):
    toks = turns(spark, d).select("conv_id", "turn", F.posexplode(text.letters(T())).alias("pos", "w"))
    return candidates.rejoin_pairs(toks, heads(spark, d), ["conv_id", "turn"], PREFIXES, {}).select("conv_id", "turn", "pos", "joined")


def stripped(spark, d):
    return candidates.suffix_strip(words(spark, d), spark.createDataFrame([(x,) for x in SUFFIXES], "suffix string"), heads(spark, d))


def abstracts(spark, d):
    """The documents' words with endings of the abstract noun, and with one of none."""
    ends = F.array(*[F.lit(x) for x in ("tvam", "tvena", "tveṣu", "tva", "ly")])
    return words(spark, d).select(F.concat("w", F.get(ends, F.length("w") % 5)).alias("w")).distinct()


def names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("headword"))
    return part.unionByName(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("headword")))


def queries():
    ent = entries
    return {
        "dict_hit_by_length": lambda s, d: _hits(s, d),
        "headword_index": lambda s, d: lexicon.headword_index(ent(s, d)).select("headword", F.array_join("dicts", ",").alias("dicts")),
        "headword_semi": lambda s, d: words(s, d).join(heads(s, d), W() == F.col("headword"), "left_semi"),
        "stopword_filter": lambda s, d: docs(s, d).select("doc_id", F.array_join(lookup.without(text.letters(T()), STOP), " ").alias("kept")),
        "tva_suffix": lambda s, d: candidates.abstract_bases(abstracts(s, d), s.createDataFrame(list(rules.ABSTRACT.items()), "suffix string, ending string")),
        "prefixed_headwords": lambda s, d: lookup.prefixed_headwords(words(s, d), prefixes(s), heads(s, d)),
        "ch_retry": lambda s, d: words(s, d).select("w", text.restored_sibilant(W()).alias("retry")).filter("retry is not null"),
        "stopword_antijoin": lambda s, d: words(s, d).join(bench_words(s, d), "w", "left_anti"),
        "type_map_expand": lambda s, d: lookup.expand_models(words(s, d).select("w", F.right("w", F.lit(1)).alias("model")), s.createDataFrame([("s", "plural"), ("t", "dental"), ("e", "vowel")], "abbr string, description string")),
        "refs_stem": lambda s, d: tables(s, d)[1].select("kind", "stem", lookup.refs_stem(F.col("refs")).alias("found")),
        "paradigm_decode": lambda s, d: shown(tables(s, d)[1].filter("kind = 'noun'").select(F.col("stem").alias("w"), "stem", "model", lookup.decoded(F.col("cells"), F.concat("stem", F.lit("en")), rules.NOUN_CASES).alias("analyses"))),
        "form_lookup": lambda s, d: lookup.form_hits(words(s, d), tables(s, d)[0], "noun", swap=False),
        "form_lookup_mswap": lambda s, d: lookup.form_hits(words(s, d).select(F.concat("w", F.lit("ṃ")).alias("w")), tables(s, d)[0].withColumn("form", F.concat("form", F.lit("m"))), "noun"),
        "noun_analysis": analysed("noun"),
        "noun_analysis_fused": analysed("noun", fused=True),
        "verb_analysis": analysed("verb", last=True),
        "verb_analysis_fused": analysed("verb", fused=True, last=False),
        "root_lookup": lambda s, d: lookup.root_lookup(words(s, d), *tables(s, d)).groupBy("w").agg(F.count("*").alias("n"), F.min("kind_ord").alias("first_kind")),
        "dict_exact": lambda s, d: lookup.dict_stage(asked(s, d), ent(s, d), 1),
        "dict_lastchar": lambda s, d: lookup.dict_stage(asked(s, d), ent(s, d), 2),
        "dict_extrachar": lambda s, d: lookup.dict_stage(asked(s, d), ent(s, d), 3),
        "dict_cascade": lambda s, d: lookup.dict_cascade(asked(s, d), ent(s, d)),
        "dict_multi": lambda s, d: lookup.dict_cascade(asked(s, d), ent(s, d)).groupBy("dict_name", "stage").agg(F.countDistinct("w").alias("n")),
        "dict_expand": lambda s, d: lookup.expanded_dicts(words(s, d), lexicon.headword_index(ent(s, d)), ["bench"]).select("w", F.array_join("dicts", ",").alias("dicts")),
        "dict_wildcard": lambda s, d: lookup.wildcard(s.createDataFrame([(p,) for p in PATTERNS], "pattern string"), heads(s, d)),
        "dict_wildcard_names": lambda s, d: lookup.wildcard(s.createDataFrame([("%a%", ), ("al%",)], "pattern string"), names(s, d).distinct()),
        "dict_star": lambda s, d: lookup.starred(s.createDataFrame([("th*",), ("ine*",)], "w string"), heads(s, d)).select("w", "headword"),
        "sam_variant_lookup": lambda s, d: lookup.sam_variants(words(s, d).select(F.concat(F.lit("saṃ"), "w").alias("w")), heads(s, d).select(F.concat(F.lit("sam"), "headword").alias("headword"))),
        "dict_search": lambda s, d: lookup.dict_search(words(s, d), ent(s, d), ["bench"]).select("w", "dict_name", "headword", F.coalesce("stage", F.lit(0)).alias("stage"), "body", "found"),
        "dict_group": lambda s, d: lookup.grouped_bodies(lookup.dict_stage(asked(s, d), ent(s, d), 1)).select("w", "dict_name", "headword", F.array_join("bodies", ",").alias("bodies")),
        "first_components": lambda s, d: lookup.first_components(lookup.dict_cascade(asked(s, d), ent(s, d))),
        "final_variants": lambda s, d: candidates.final_variants(words(s, d), closed(s)),
        "prefix_strip": lambda s, d: candidates.prefix_strip(words(s, d), prefixes(s)),
        "root_cascade": cascade,
        "root_cascade_full": lambda s, d: candidates.root_cascade(words(s, d), heads(s, d)).select("w", "rank", "cand"),
        "prefix_rejoin": rejoined,
        "suffix_strip": stripped,
        "split_score": split_scores,
        "split_all_known": known_splits,
        "longest_prefix": lambda s, d: segment.longest_prefix(words(s, d), heads(s, d)),
        "best_prefix_split": lambda s, d: segment.best_prefix_split(words(s, d), heads(s, d)),
        "hybrid_choose": chosen,
        "segment_greedy": lambda s, d: flat_parts(segment.segment_greedy(words(s, d), heads(s, d))),
        "segment_nbest": lambda s, d: segment.segment_nbest(words(s, d), heads(s, d)).select("w", "rank", F.array_join("parts", "+").alias("parts"), "score"),
        "translit_slp1_iast": lambda s, d: words(s, d).select("w", translit.slp1_to_iast(F.translate(W(), "abdt", "AEDT")).alias("iast")),
        "translit_round_trip": lambda s, d: words(s, d).select("w", translit.transliterate(translit.transliterate(W(), "Devanagari", "SLP1"), "SLP1", "Devanagari").alias("again")),
    }


def _hits(spark, d):
    toks = docs(spark, d).select(F.explode(text.letters(T())).alias("w"))
    known = heads(spark, d).select(F.col("headword").alias("w"), F.lit(1).alias("hit"))
    return toks.join(known, "w", "left").groupBy(F.length("w").cast("bigint").alias("length")).agg(F.count("*").alias("tokens"), F.count("hit").alias("hits"))


def oracle_sql():
    slp1 = [(a, b) for a, b in zip(translit._sounds("SLP1"), translit._sounds("IAST"), strict=True) if a != b]
    fold = "list_transform(string_split(translate(w, 'abdt', 'AEDT'), ''), lambda c: coalesce(MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in slp1) + "}[c], c))"
    cols = "w, dict_name, headword, components, body, body_pos, stage"
    return {
        "dict_hit_by_length": f"WITH {E}, tok AS (SELECT unnest({LETTERS}) AS w FROM documents) SELECT length(w) AS length, count(*) AS tokens, count(headword) AS hits FROM tok LEFT JOIN heads ON w = headword GROUP BY ALL",
        "headword_index": f"WITH {E} SELECT headword, array_to_string(list_sort(list(DISTINCT dict_name)), ',') AS dicts FROM entry GROUP BY headword",
        "headword_semi": f"{EW} SELECT w FROM wordlist SEMI JOIN heads ON w = headword",
        "stopword_filter": f"SELECT doc_id, array_to_string(list_filter({LETTERS}, lambda x: x NOT IN {sql_in(STOP)}), ' ') AS kept FROM documents",
        "tva_suffix": f"WITH {WORDS}, n AS (SELECT w || (['tvam', 'tvena', 'tveṣu', 'tva', 'ly'])[length(w) % 5 + 1] AS w FROM wordlist), s(suffix, ending) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in rules.ABSTRACT.items())}), c AS (SELECT w, left(w, length(w) - length(suffix)) AS base, ending FROM n JOIN s ON ends_with(w, suffix) AND length(w) > length(suffix) QUALIFY row_number() OVER (PARTITION BY w ORDER BY length(suffix) DESC) = 1) SELECT w, CASE WHEN right(base, 1) = 'a' THEN left(base, length(base) - 1) || ending ELSE base END AS form FROM c",
        "prefixed_headwords": f"{EW}, {PREFIX_SQL}, t AS (SELECT w, -1 AS ord, '' AS prefix, w AS rest FROM wordlist UNION ALL {STRIPPED.replace('SELECT w, ord, prefix, substr', 'SELECT w, ord, prefix, substr')}) SELECT w, min_by(prefix, ord) AS prefix FROM t WHERE rest IN (SELECT headword FROM heads) GROUP BY w",
        "ch_retry": f"WITH {WORDS} SELECT w, 'ś' || substr(w, 2) AS retry FROM wordlist WHERE w LIKE 'ch%'",
        "stopword_antijoin": f"{EW} SELECT w FROM wordlist WHERE w NOT IN (SELECT headword FROM entry WHERE dict_name = 'bench')",
        "type_map_expand": f"WITH {WORDS} SELECT w, CASE right(w, 1) WHEN 's' THEN 'plural' WHEN 't' THEN 'dental' WHEN 'e' THEN 'vowel' ELSE right(w, 1) END AS model FROM wordlist",
        "refs_stem": rf"WITH {P} SELECT kind, stem, regexp_extract(refs, ',(\p{{L}}+)', 1) AS found FROM paradigm",
        "paradigm_decode": f"WITH {P} SELECT stem AS w, stem, model, {decode_sql('noun', 'form0')} FROM (SELECT *, stem || 'en' AS form0 FROM paradigm WHERE kind = 'noun')",
        "form_lookup": f"{PW} SELECT w, form, model, stem, ord FROM ({hits_sql('noun')})",
        "form_lookup_mswap": f"{PW} SELECT w || 'ṃ' AS w, form || 'm' AS form, model, stem, ord FROM ({hits_sql('noun')})",
        "noun_analysis": analysed_sql("noun", True),
        "noun_analysis_fused": f"{PW}, hits AS ({hits_sql('noun', True)}) SELECT w, stem, model, {decode_sql('noun', 'w')} FROM hits JOIN paradigm USING (stem, model)",
        "verb_analysis": analysed_sql("verb", False, "DESC"),
        "verb_analysis_fused": analysed_sql("verb", False, "ASC"),
        "root_lookup": f"{PW}, n AS ({hits_sql('noun', True)}), v AS ({hits_sql('verb')}) SELECT w, count(*) AS n, min(k) AS first_kind FROM (SELECT w, 0 AS k FROM n UNION ALL SELECT w, 1 FROM v) GROUP BY w",
        "dict_exact": f"{EW}, {ASKED} {STAGE[1]}",
        "dict_lastchar": f"{EW}, {ASKED} {STAGE[2]}",
        "dict_extrachar": f"{EW}, {ASKED} {STAGE[3]}",
        "dict_cascade": f"{CASCADE} SELECT {cols} FROM cas",
        "dict_multi": f"{CASCADE} SELECT dict_name, stage, count(DISTINCT w) AS n FROM cas GROUP BY ALL",
        "dict_expand": f"{EW}, i AS (SELECT headword, list_sort(list(DISTINCT dict_name)) AS dicts FROM entry GROUP BY headword) SELECT w, CASE WHEN dicts IS NULL OR list_contains(dicts, 'bench') THEN 'bench' ELSE 'bench,' || array_to_string(dicts, ',') END AS dicts FROM wordlist LEFT JOIN i ON w = headword",
        "dict_wildcard": f"WITH {E}, p(pattern) AS (VALUES {', '.join(f"('{p}')" for p in PATTERNS)}) SELECT pattern, headword FROM p JOIN heads ON headword ILIKE pattern",
        "dict_wildcard_names": "WITH p(pattern) AS (VALUES ('%a%'), ('al%')), n AS (SELECT DISTINCT p_name AS headword FROM part UNION SELECT n_name FROM nation) SELECT pattern, headword FROM p JOIN n ON headword ILIKE pattern",
        "dict_star": f"WITH {E} SELECT 'th*' AS w, headword FROM heads WHERE headword LIKE 'th%' UNION ALL SELECT 'ine*', headword FROM heads WHERE headword LIKE 'ine%'",
        "sam_variant_lookup": f"{EW} SELECT 'saṃ' || w AS w, 'sam' || w AS headword FROM wordlist WHERE w IN (SELECT headword FROM heads)",
        "dict_search": f"{EW}, i AS (SELECT headword, list(DISTINCT dict_name) AS dicts FROM entry GROUP BY headword), asked AS (SELECT w, unnest(CASE WHEN dicts IS NULL OR list_contains(dicts, 'bench') THEN ['bench'] ELSE ['bench'] || dicts END) AS dict_name FROM wordlist LEFT JOIN i ON w = headword), st AS ({STAGE[1]} UNION ALL {STAGE[2]} UNION ALL {STAGE[3]}), cas AS (SELECT * FROM st QUALIFY stage = min(stage) OVER (PARTITION BY w, dict_name)) SELECT wl.w, dict_name, headword, coalesce(stage, 0) AS stage, body, headword IS NOT NULL AS found FROM wordlist wl LEFT JOIN cas ON wl.w = cas.w",
        "dict_group": f"{EW}, {ASKED}, s AS ({STAGE[1]}) SELECT w, dict_name, headword, string_agg(body, ',' ORDER BY body_pos) AS bodies FROM s GROUP BY ALL",
        "first_components": f"{CASCADE} SELECT w, min_by(components, struct_pack(a := dict_name, b := headword, c := body_pos)) AS components FROM cas WHERE components <> '' GROUP BY w",
        "final_variants": f"WITH {WORDS}, {CLOSED_SQL} {VARIANTS}",
        "prefix_strip": f"WITH {WORDS}, {PREFIX_SQL} {STRIPPED}",
        "root_cascade": CASCADE_ROOT,
        "prefix_rejoin": f"WITH {E}, t AS (SELECT conv_id, turn, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS w FROM (SELECT conv_id, turn, {LETTERS} AS l FROM conversations)), a AS (SELECT *, w || lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS joined FROM t) SELECT conv_id, turn, pos, joined FROM a SEMI JOIN heads ON joined = headword WHERE w IN {sql_in(PREFIXES)}",
        "suffix_strip": f"{EW}, sx(suffix) AS (VALUES {', '.join(f"('{x}')" for x in SUFFIXES)}), c AS (SELECT w, left(w, length(w) - length(suffix)) AS base, suffix FROM wordlist JOIN sx ON w LIKE '%' || suffix WHERE length(w) > length(suffix)) SELECT w, base, suffix FROM c WHERE base IN (SELECT headword FROM heads) QUALIFY row_number() OVER (PARTITION BY w ORDER BY length(suffix) DESC) = 1",
        "split_score": f"{SCORED} SELECT w, i, score FROM sc",
        "split_all_known": f"{EW}, {CUTS} SELECT w, CAST(sum(CAST(first IN (SELECT headword FROM heads) AND rest IN (SELECT headword FROM heads) AS INT)) AS BIGINT) AS n_known FROM cut WHERE rest <> '' GROUP BY w",
        "longest_prefix": f"{EW}, c AS (SELECT w, left(w, i) AS first FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM wordlist WHERE length(w) > 1)) SELECT w, max_by(first, length(first)) AS first FROM c SEMI JOIN heads ON first = headword GROUP BY w",
        "best_prefix_split": f"{SCORED}, b AS (SELECT w, first, rest, score FROM sc QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, length(first) DESC) = 1) SELECT * FROM b WHERE score >= {segment.ACCEPT}",
        "translit_slp1_iast": f"WITH {WORDS} SELECT w, array_to_string({fold}, '') AS iast FROM wordlist",
        "translit_round_trip": f"WITH {WORDS} SELECT w, w AS again FROM wordlist",
    }
