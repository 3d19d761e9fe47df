"""Queries on the text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text



def T():
    return F.col("text")


def W():
    return F.col("w")


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def words(spark, d):
    """Distinct letter tokens of the documents."""
    return docs(spark, d).select(F.explode(text.letters(T())).alias("w")).distinct()


WORDS = r"""wordlist AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS w FROM documents)"""
TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def sql_in(items) -> str:
    return "(" + sql_list(items)[1:-1] + ")"


def sql_map(m) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"


STOP = ["the", "of", "and", "to", "le", "la", "de", "et", "der", "die", "und", "que", "el", "en", "in", "is"]
TAGS = ["The", "Of", "Le", "De", "Die", "El"]

DETECT = f"""CASE WHEN text IS NULL THEN NULL
 WHEN regexp_matches(text, '[ऀ-ൿ]') THEN CASE {" ".join(f"WHEN unicode(regexp_extract(text, '[ऀ-ൿ]')) >= {c} THEN '{n}'" for n, c in text.BLOCKS.items())} END
 WHEN regexp_matches(text, '{text.IAST}') THEN CASE WHEN regexp_matches(text, '{text.KOLKATA}') THEN 'Kolkata' ELSE 'IAST' END
 WHEN regexp_matches(text, '{text.ITRANS}') THEN 'ITRANS' WHEN regexp_matches(text, '{text.SLP1}') THEN 'SLP1'
 WHEN regexp_matches(text, '{text.VELTHUIS}') THEN 'Velthuis' WHEN regexp_matches(text, '{text.SHARED}') THEN 'ITRANS' ELSE 'HK' END"""
TRUNC = """CASE WHEN length(text) <= 100 THEN text WHEN instr(reverse(left(text, 100)), ' ') > 0
 THEN left(text, 100 - instr(reverse(left(text, 100)), ' ')) ELSE left(text, 100) END"""


def normal_sql(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace({x}, 'jj', 'j j'), 'o''', 'aḥ a'), '^''', 'a'), '[^\p{{L}}''_%*+]', ' ', 'g'), '\s+', ' ', 'g'))"""


SPLITS = f"""{WORDS}, cut AS (SELECT w, i, [left(w, i), substr(w, i + 1)] AS parts FROM (SELECT w, unnest(range(2, length(w) - 1)) AS i FROM wordlist WHERE length(w) >= 4))"""
MORPH = f"""greatest(0.0, least(0.3, list_sum(list_transform(parts, lambda p: 0.3 / len(parts) * (
 CASE WHEN length(p) >= 6 THEN 0.7 WHEN length(p) >= 4 THEN 0.4 ELSE 0.0 END
 + CASE WHEN p IN {sql_in(rules.INDECLINABLES)} THEN 0.7 WHEN p IN {sql_in(rules.SCORED_PREFIXES)} THEN 0.4 ELSE 0.0 END
 - CASE WHEN length(p) <= 2 AND p NOT IN {sql_in(rules.INDECLINABLES)} AND p NOT IN {sql_in(rules.SCORED_PREFIXES)} THEN 1.0 ELSE 0.0 END
 + CASE WHEN regexp_matches(p, '(ana|ita|aka|in|tva|tā)$') THEN 0.7 ELSE 0.0 END)))))"""
LEN = "0.5 * pow(len(parts) / (length(w) / 8.0), CASE WHEN len(parts) / (length(w) / 8.0) > 1 THEN -1.3 ELSE -1.2 END)"


def cuts(spark, d):
    """Every split of the documents' words in two parts of two letters or more."""
    w = words(spark, d).filter(F.length("w") >= 4)
    w = w.select("w", F.explode(F.sequence(F.lit(2), F.length("w") - 2)).alias("i"))
    return w.withColumn("parts", F.array(F.expr("left(w, i)"), F.expr("substring(w, i + 1)")))


def ranked(spark, d):
    from pyspark.sql import Window

    scored = cuts(spark, d).withColumn("score", F.round(text.split_score(F.col("w"), F.col("parts")), 6))
    by = Window.partitionBy("w").orderBy(F.desc("score"), "i")
    return scored.withColumn("rank", F.row_number().over(by).cast("bigint")).select("w", F.col("i").cast("bigint").alias("i"), "score", "rank")


RANKED = f"""WITH {SPLITS}, s AS (SELECT w, i, round({LEN} + {MORPH}, 6) AS score FROM cut)
SELECT w, i, score, row_number() OVER (PARTITION BY w ORDER BY score DESC, i) AS rank FROM s"""


def queries():
    sel = lambda col, **kw: lambda s, d: docs(s, d).select("doc_id", *[f(col()).alias(k) for k, f in kw.items()])
    one = lambda col, **kw: lambda s, d: words(s, d).select("w", *[f(col()).alias(k) for k, f in kw.items()])
    return {
        "detect_scheme": sel(T, scheme=text.detect_scheme),
        "detect_scheme_hist": lambda s, d: docs(s, d).groupBy("lang", text.detect_scheme(T()).alias("scheme")).agg(F.count("*").alias("n")),
        "truncate_ws": sel(T, cut=text.truncate_ws),
        "preprocess_text": sel(T, clean=text.preprocess),
        "final_sandhi_fix": one(W, fixed=text.fix_final),
        "nasal_retry": lambda s, d: words(s, d).select("w", F.posexplode(text.nasal_candidates(F.translate(W(), "nm", "ṅṁ"))).alias("rank", "candidate")),
        "explicit_split": lambda s, d: docs(s, d).select("doc_id", F.posexplode(text.tokens(T())).alias("pos", "token")).select("doc_id", "pos", F.posexplode(text.explicit_parts("token")).alias("part_no", "part")),
        "stopword_text": sel(T, kept=lambda c: text.drop_words(c, STOP)),
        "tag_strip": sel(T, clean=lambda c: text.strip_tags(c, TAGS)),
        "component_parts": lambda s, d: docs(s, d).select("doc_id", F.posexplode(text.component_parts(T())).alias("pos", "part")),
        "normalize_ending": one(lambda: F.translate(W(), "aiu", "āīū"), short=text.short_ending),
        "strip_markers": sel(lambda: F.concat(F.lit("|| YS_1.2 || "), T(), F.lit(" ||A.3||")), clean=text.strip_markers),
        "tokenize": lambda s, d: docs(s, d).select("doc_id", F.posexplode(text.tokens(T())).alias("pos", "token")),
        "model_prefix": sel(T, prompt=lambda c: text.prompt(c, "lemma")),
        "fallback_original": lambda s, d: docs(s, d).select("doc_id", text.or_original(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.reverse(T())), T()).alias("out")),
        "adjacent_dedup": lambda s, d: turns(s, d).select("conv_id", "turn", F.posexplode(text.adjacent_distinct(text.letters(T()))).alias("pos", "w")),
        "score_length": lambda s, d: cuts(s, d).select("w", F.col("i").cast("bigint").alias("i"), F.round(text.length_score(F.length("w"), F.size("parts")), 6).alias("score")),
        "score_morphology": lambda s, d: cuts(s, d).select("w", F.col("i").cast("bigint").alias("i"), F.round(text.morphology_score(F.col("parts")), 6).alias("score")),
        "score_split": lambda s, d: ranked(s, d).drop("rank"),
        "rank_splits": ranked,
        "top1_split": lambda s, d: ranked(s, d).filter("rank = 1").drop("rank"),
    }


def oracle_sql():
    q = lambda expr, name: f"SELECT doc_id, {expr} AS {name} FROM documents"
    one = lambda expr, name: f"WITH {WORDS} SELECT w, {expr} AS {name} FROM wordlist"
    pos = lambda keys, lst, name, src: f"SELECT {keys}, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS {name} FROM (SELECT {keys}, {lst} AS l FROM {src})"
    return {
        "detect_scheme": q(DETECT, "scheme"),
        "detect_scheme_hist": f"SELECT lang, {DETECT} AS scheme, count(*) AS n FROM documents GROUP BY ALL",
        "truncate_ws": q(TRUNC, "cut"),
        "preprocess_text": q(normal_sql("text"), "clean"),
        "final_sandhi_fix": one(f"left(w, length(w) - 1) || coalesce({sql_map(rules.FINAL_FIX)}[right(w, 1)], right(w, 1))", "fixed"),
        "nasal_retry": f"WITH {WORDS}, c AS (SELECT w, translate(w, 'nm', 'ṅṁ') AS a FROM wordlist), l AS (SELECT w, [a] || CASE WHEN replace(a, 'ṅ', 'ṃ') <> a THEN [replace(a, 'ṅ', 'ṃ')] ELSE [] END || CASE WHEN replace(replace(a, 'ṅ', 'ṃ'), 'ṁ', 'ṃ') NOT IN (a, replace(a, 'ṅ', 'ṃ')) THEN [replace(replace(a, 'ṅ', 'ṃ'), 'ṁ', 'ṃ')] ELSE [] END AS l FROM c) SELECT w, CAST(unnest(range(len(l))) AS INT) AS rank, unnest(l) AS candidate FROM l",
        "explicit_split": "SELECT doc_id, pos, CAST(unnest(range(len(l))) AS INT) AS part_no, unnest(l) AS part FROM (SELECT doc_id, pos, list_filter(regexp_split_to_array(token, '[-+]'), lambda x: x <> '') AS l FROM (" + pos("doc_id", TOKENS, "token", "documents") + "))",
        "stopword_text": q(f"array_to_string(list_filter({TOKENS.replace('text', "replace(text, '.', '')", 1)}, lambda x: x NOT IN {sql_in(STOP)}), ' ')", "kept"),
        "tag_strip": q(f"array_to_string(list_filter({TOKENS.replace('text', "replace(text, '_', ' ')", 1)}, lambda x: x NOT IN {sql_in(TAGS)}), ' ')", "clean"),
        "component_parts": r"WITH p AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS part FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[-—,/]'), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\p{L}]', '', 'g')) AS l FROM documents)), f AS (SELECT doc_id, part, min(i) AS i FROM p GROUP BY ALL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, part FROM f",
        "normalize_ending": one("left(translate(w, 'aiu', 'āīū'), length(w) - 1) || translate(right(translate(w, 'aiu', 'āīū'), 1), 'āīūṝ', 'aiuṛ')", "short"),
        "strip_markers": q(r"trim(regexp_replace(regexp_replace('|| YS_1.2 || ' || text || ' ||A.3||', '\|\|\s*[A-Z_0-9.]+\s*\|\|', ' ', 'g'), '\s+', ' ', 'g'))", "clean"),
        "tokenize": pos("doc_id", TOKENS, "token", "documents"),
        "model_prefix": q("'L ' || text", "prompt"),
        "fallback_original": q("CASE WHEN doc_id % 3 = 0 AND trim(text) <> '' THEN text WHEN doc_id % 3 = 0 THEN '  ' ELSE reverse(text) END", "out"),
        "adjacent_dedup": "WITH t AS (SELECT conv_id, turn, l, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS k FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS l FROM conversations)) SELECT conv_id, turn, CAST(unnest(range(len(k))) AS INT) AS pos, unnest(k) AS w FROM t",
        "score_length": f"WITH {SPLITS} SELECT w, i, round({LEN}, 6) AS score FROM cut",
        "score_morphology": f"WITH {SPLITS} SELECT w, i, round({MORPH}, 6) AS score FROM cut",
        "score_split": f"SELECT w, i, score FROM ({RANKED})",
        "rank_splits": RANKED,
        "top1_split": f"SELECT w, i, score FROM ({RANKED}) WHERE rank = 1",
    }
