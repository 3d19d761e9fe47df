"""Column functions on text: scheme detection, normalisation, tokens, small rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: First code point of each script's block.
BLOCKS = {
    "Malayalam": 0x0D00, "Kannada": 0x0C80, "Telugu": 0x0C00, "Tamil": 0x0B80, "Oriya": 0x0B00, "Gujarati": 0x0A80,
    "Gurmukhi": 0x0A00, "Bengali": 0x0980, "Devanagari": 0x0900,
}
# Characters that tell the romanisations apart.
IAST = "[āīūṛṝḷḹēōṃḥṅñṭḍṇśṣḻ]"
KOLKATA = "[ēō]"
ITRANS = r"ee|oo|\^[iI]|RR[iI]|L[iI]|~N|N\^|Ch|chh|JN|sh|Sh|\.a"
SLP1 = r"[fFxXEOCYwWqQPB]|kz|Nk|Ng|tT|dD|Sc|Sn|[aAiIuUfFxXeEoO]R|G[yr]|([^\p{L}\p{M}\p{N}_]|^)G"
VELTHUIS = r'\.[mhnrlntds]|"n|~s'
SHARED = "aa|ii|uu|~n"


def detect_scheme(text: Column) -> Column:
    """One of 15 scheme names; null for a null text."""
    first = F.regexp_extract(text, "[ऀ-ൿ]", 0)
    code = F.ascii(first)
    block = F.when(first == "", F.lit(None).cast("string"))
    for name, start in BLOCKS.items():
        block = block.when(code >= start, name)
    roman = (
        F.when(text.rlike(IAST), F.when(text.rlike(KOLKATA), "Kolkata").otherwise("IAST"))
        .when(text.rlike(ITRANS), "ITRANS")
        .when(text.rlike(SLP1), "SLP1")
        .when(text.rlike(VELTHUIS), "Velthuis")
        .when(text.rlike(SHARED), "ITRANS")
        .otherwise("HK")
    )
    return F.when(text.isNotNull(), F.coalesce(block, roman))


def truncate_ws(text: Column, most: int = 100) -> Column:
    """Cut longer texts at the last blank among the first ``most`` characters, or hard without one."""
    head = F.left(text, F.lit(most))
    back = F.instr(F.reverse(head), " ")
    return F.when(F.length(text) <= most, text).when(back > 0, F.left(text, F.lit(most) - back)).otherwise(head)


def normalise(text: Column, compat: bool = False) -> Column:
    """Repairs, then letters, apostrophes and wildcards only; ``compat`` drops hyphens too."""
    out = F.replace(text, F.lit("jj"), F.lit("j j"))
    out = F.replace(out, F.lit("o'"), F.lit("aḥ a"))
    out = F.regexp_replace(out, "^'", "a")
    out = F.regexp_replace(out, r"[^\p{L}'_%*+]" if compat else r"[^\p{L}'_%*+-]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def preprocess(text: Column, most: int | None = None, compat: bool = True) -> Column:
    """The normalised text; only its first ``most`` characters, or so, where a phrase is to be cut."""
    return normalise(text if most is None else truncate_ws(text, most), compat)


def letters(text: Column) -> Column:
    """array<string>: lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """array<string>: what white space separates."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def fix_final(word: Column) -> Column:
    last = F.right(word, F.lit(1))
    fixed = F.coalesce(F.try_element_at(rules.literal_map(rules.FINAL_FIX), last), last)
    return F.when(F.length(word) > 0, F.concat(F.left(word, F.length(word) - 1), fixed)).otherwise(word)


def nasal_candidates(word: Column) -> Column:
    """array<string>: the word, and its respellings of nasals, each once."""
    first = F.replace(word, F.lit("ṅ"), F.lit("ṃ"))
    return F.array_distinct(F.array(word, first, F.replace(first, F.lit("ṁ"), F.lit("ṃ"))))


def restored_sibilant(word: Column) -> Column:
    """A word in ch with ś for its first sound; null for others."""
    return F.when(word.startswith("ch"), F.concat(F.lit("ś"), word.substr(2, 1 << 30)))


def repaired_json(body: Column, schema: str) -> Column:
    """The parsed text; if that fails, parsed with a closing quote (and what that leaves open closed); else null."""
    strict = {"mode": "PERMISSIVE"}
    marked = f"{schema}, __bad string"

    def parsed(x: Column) -> Column:
        got = F.from_json(x, marked, strict | {"columnNameOfCorruptRecord": "__bad"})
        return F.when(got.isNotNull() & got["__bad"].isNull(), got)

    tries = [body, F.concat(body, F.lit('"')), F.concat(body, F.lit('"}'))]
    return F.coalesce(*[parsed(x) for x in tries]).dropFields("__bad")


def explicit_parts(word: Column) -> Column:
    return F.filter(F.split(word, "[-+]"), lambda p: p != "")


def drop_words(text: Column, words: list[str]) -> Column:
    """A text without points and without the given words, blanks collapsed."""
    kept = F.filter(tokens(F.replace(text, F.lit("."), F.lit(""))), lambda w: ~w.isin(words))
    return F.array_join(kept, " ")


def strip_tags(text: Column, tags: list[str] | None = None) -> Column:
    kept = F.filter(tokens(F.replace(text, F.lit("_"), F.lit(" "))), lambda w: ~w.isin(tags or rules.MODEL_TAGS))
    return F.array_join(kept, " ")


def component_parts(components: Column) -> Column:
    """array<string>: letters of each part, in order, each once; empty for a null."""
    parts = F.filter(F.split(components, "[-—,/]"), lambda p: p != "")
    return F.coalesce(F.array_distinct(F.transform(parts, lambda p: F.regexp_replace(p, r"[^\p{L}]", ""))), F.array().cast("array<string>"))


def short_ending(word: Column) -> Column:
    """A final long vowel made short."""
    return F.concat(F.left(word, F.length(word) - 1), F.translate(F.right(word, F.lit(1)), "āīūṝ", "aiuṛ"))


def strip_markers(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\|\|\s*[A-Z_0-9.]+\s*\|\|", " "), r"\s+", " "))


def adjacent_distinct(words: Column) -> Column:
    return F.filter(words, lambda x, i: (i == 0) | (x != F.get(words, i - 1)))


def prompt(text: Column, task: str = "segmentation") -> Column:
    return F.concat(F.lit(rules.MODEL_TASKS.get(task, "S ")), text)


def or_original(output: Column, text: Column) -> Column:
    blank = F.coalesce(F.trim(output), F.lit("")) == ""
    return F.when(blank & (F.trim(text) != ""), text).otherwise(output)


def length_score(length: Column, pieces: Column) -> Column:
    """0.5 for eight characters a piece; longer pieces score more, shorter ones less."""
    ratio = pieces / (length / 8.0)
    return F.when(ratio > 1, 0.5 * F.pow(ratio, F.lit(-1.3))).otherwise(0.5 * F.pow(ratio, F.lit(-1.2)))


def morphology_score(words: Column) -> Column:
    """0 to 0.3: long words, particles, prefixes and derived endings add, stray short words take away."""
    share = F.lit(0.3) / F.size(words)

    def one(w: Column) -> Column:
        n, particle, prefix = F.length(w), w.isin(rules.INDECLINABLES), w.isin(rules.SCORED_PREFIXES)
        return (
            F.when(n >= 6, 0.7).when(n >= 4, 0.4).otherwise(0.0)
            + F.when(particle, 0.7).when(prefix, 0.4).otherwise(0.0)
            - F.when((n <= 2) & ~particle & ~prefix, 1.0).otherwise(0.0)
            + F.when(w.rlike("(ana|ita|aka|in|tva|tā)$"), 0.7).otherwise(0.0)
        )

    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + one(w) * share)
    return F.when(F.size(words) > 0, F.least(F.lit(0.3), F.greatest(F.lit(0.0), total))).otherwise(0.0)


def split_score(text: Column, words: Column) -> Column:
    return length_score(F.length(text), F.size(words)) + morphology_score(words)


def format_roots(groups: Column) -> Column:
    """array<array<string>> as text; several readings of one word in brackets."""
    one = F.transform(
        groups, lambda g: F.when(F.size(g) > 1, F.concat(F.lit("("), F.array_join(g, " | "), F.lit(")"))).otherwise(F.get(g, 0))
    )
    return F.array_join(one, " ")


def accuracy(predicted: Column, parts: Column, expected: Column) -> Column:
    """Share of expected roots found exactly (among roots or parts), or half for another final vowel."""
    both = F.array_union(predicted, parts)
    exact = F.array_intersect(expected, both)
    loose = F.transform(predicted, short_ending)
    half = F.filter(expected, lambda e: ~F.array_contains(exact, e) & F.array_contains(loose, short_ending(e)))
    return (F.size(exact) + 0.5 * F.size(half)) / F.size(expected)
