"""Rule relations of the annotation language.

Fixed values: the tables below must hold exactly these values for right results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word-final character -> underlying finals, in the order they are tried.
FINALS = {
    "k": ["t", "c", "ś"],
    "ṭ": ["t", "ś", "ṣ"],
    "t": ["d"],
    "n": ["t", "m", "ṃ"],
    "p": ["t", "b"],
    "ḍ": ["t", "d"],
    "s": ["ś", "ṣ", "ḥ"],
    "ś": ["k", "ḥ"],
    "ṣ": ["k", "ḥ", "t"],
    "r": ["ḥ", "s"],
    "o": ["aḥ", "as", "au"],
    "j": ["t"],
    "ṃ": ["m"],
    "c": ["t"],
    "ā": ["āḥ"],
}
#: Unconditional repair of a word's last character.
FINAL_FIX = {"y": "i", "r": "ḥ", "v": "u", "d": "t", "b": "p", "g": "k", "ś": "ḥ"}
#: Segment ending in the key: vowels that the next segment may have lost.
LOST_INITIALS = {"ā": ["a", "ā"], "ī": ["i", "ī"], "ū": ["u", "ū"], "e": ["i"], "o": ["u"]}
#: Segment-final characters -> spellings that are looked up too.
VARIANTS = {
    "ā": ["a", "ā"],
    "ī": ["i", "ī"],
    "ū": ["u", "ū"],
    "ḥ": ["s", "r", "ḥ"],
    "o": ["a", "ā", "o", "u"],
    "e": ["a", "ā", "e"],
    "n": ["m", "ṃ", "n"],
    "t": ["d", "t"],
    "d": ["t", "d"],
    "ṃ": ["m", "n"],
    "c": ["k", "d"],
    "j": ["k", "g", "j", "d", "t"],
    "ṣ": ["s", "ṣ", "ś"],
    "y": ["i", "y"],
    "v": ["v", "u"],
}
#: Preverbs, in the order they are stripped.
PREFIXES = [
    "sam", "saṃ", "anu", "abhi", "ati", "adhi", "apa", "api", "ava", "ā", "a", "ud", "upa", "nis", "parā", "pari",
    "pra", "prati", "praty", "vi", "vy", "ut", "ni",
]
#: Segments that are joined to the next one before it is analysed.
JOINING = [
    "sva", "anu", "sam", "pra", "upa", "vi", "nis", "abhi", "ni", "pari", "prati", "parā", "ava", "adhi", "api", "ati",
    "ud", "dvi", "su", "dur", "duḥ",
]
JOINED_SPELLINGS = {"sam": ["sam", "saṃ"], "vi": ["vi", "vy"]}
#: Members count as prefixes in the score of a split.
SCORED_PREFIXES = [
    "ā", "ati", "adhi", "anu", "apa", "api", "abhi", "ava", "ud", "upa", "dur", "ni", "nir", "nis", "parā", "pari",
    "pra", "prati", "vi", "sam", "su",
]
INDECLINABLES = ["iva", "eva", "ca", "vā", "hi", "tu", "api", "iti", "yathā", "tathā", "yatra", "tatra"]
FILTERED = ["ca", "na", "eva", "ni", "apya", "ava", "sva"]
#: Spellings of one preverb before different sounds.
SAM = {"sam": "saṃ", "saṃ": "sam", "saṅ": "saṃ", "san": "saṃ", "sañ": "saṃ"}
#: Segment endings that make a split less likely.
PENALTIES = {"ka": 0.5, "sa": 0.3}
#: Forms of the abstract noun in -tva -> ending that its base takes in the same case.
ABSTRACT = {
    "tvam": "am",
    "tvena": "ena",
    "tvāya": "āya",
    "tvāt": "āt",
    "tvasya": "asya",
    "tve": "e",
    "tvābhyām": "ābhyām",
    "tvayoḥ": "ayoḥ",
    "tvāni": "āni",
    "tvebhyaḥ": "ebhyaḥ",
    "tvānām": "ānām",
    "tveṣu": "eṣu",
    "tva": "",
    "tvā": "",
}
#: Stems that may stand, once or often, between a preverb and the stem that it is joined with.
SKIPPED = {"sam": ["sa", "sam"], "anu": ["anu"], "ava": ["ava"]}
#: Tags that a segmentation model may leave in its output.
MODEL_TAGS = ["cp", "snf", "SNNe", "PNF", "SNM", "U", "SGNe", "SBM", "SNF", "ḷ"]
MODEL_TASKS = {
    "segmentation": "S ",
    "segmentation-morphosyntax": "SM ",
    "lemma": "L ",
    "lemma-morphosyntax": "LM ",
    "segmentation-lemma-morphosyntax": "SLM ",
}
NOUN_CASES = ["Nom", "Acc", "Inst", "Dat", "Abl", "Gen", "Loc", "Voc"]
PERSONS = ["First", "Second", "Third"]
NUMBERS = ["Sg", "Du", "Pl"]


def literal_map(rules: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])


def relation(spark: SparkSession, rules: dict[str, list[str]]) -> DataFrame:
    """(lhs, rhs, ord): one row a replacement; a small table of fixed size."""
    rows = [(k, v, i) for k, vs in rules.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "lhs string, rhs string, ord int")
