"""Transliteration between 15 schemes, by way of one list of sounds.

Roman schemes are longest-match replacements; Indic scripts share one block layout, so a script is its
first code point, and writing it needs only the inherent vowel and the mark that removes it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import BLOCKS, detect_scheme

# The sounds, in the same order in every scheme (public standards).
VOWELS = {
    "IAST": "a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(),
    "KOLKATA": "a ā i ī u ū ṛ ṝ ḷ ḹ ē ai ō au".split(),
    "HK": "a A i I u U R RR lR lRR e ai o au".split(),
    "SLP1": "a A i I u U f F x X e E o O".split(),
    "ITRANS": "a A i I u U RRi RRI LLi LLI e ai o au".split(),
    "VELTHUIS": "a aa i ii u uu .r .rr .l .ll e ai o au".split(),
}
MARKS = {
    "IAST": "ṃ ḥ '".split(),
    "KOLKATA": "ṃ ḥ '".split(),
    "HK": "M H '".split(),
    "SLP1": "M H '".split(),
    "ITRANS": "M H .a".split(),
    "VELTHUIS": ".m .h .a".split(),
}
CONSONANTS = {
    "IAST": "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split(),
    "HK": "k kh g gh G c ch j jh J T Th D Dh N t th d dh n p ph b bh m y r l v z S s h".split(),
    "SLP1": "k K g G N c C j J Y w W q Q R t T d D n p P b B m y r l v S z s h".split(),
    "ITRANS": "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h".split(),
    "VELTHUIS": 'k kh g gh "n c ch j jh ~n .t .th .d .dh .n t th d dh n p ph b bh m y r l v "s .s s h'.split(),
}
CONSONANTS["KOLKATA"] = CONSONANTS["IAST"]
#: Offsets in an Indic block: independent vowels, vowel signs, marks, consonants, the mark for no vowel.
VOWEL_AT = [0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B, 0x60, 0x0C, 0x61, 0x0F, 0x10, 0x13, 0x14]
SIGN_AT = [None, 0x3E, 0x3F, 0x40, 0x41, 0x42, 0x43, 0x44, 0x62, 0x63, 0x47, 0x48, 0x4B, 0x4C]
MARK_AT = [0x02, 0x03, 0x3D]
CONSONANT_AT = [*range(0x15, 0x29), *range(0x2A, 0x2F), 0x2F, 0x30, 0x32, 0x35, 0x36, 0x37, 0x38, 0x39]
VIRAMA = 0x4D
INDIC = {name.upper(): start for name, start in BLOCKS.items()}


def _sounds(scheme: str) -> list[str]:
    return VOWELS[scheme] + MARKS[scheme] + CONSONANTS[scheme]


@lru_cache(64)
def _roman_table(scheme: str) -> tuple[dict[str, int], int]:
    table = {s: i for i, s in enumerate(_sounds(scheme))}
    return table, max(map(len, table))


def _read_roman(word: str, scheme: str) -> list[int | str]:
    table, longest = _roman_table(scheme)
    out: list[int | str] = []
    i = 0
    while i < len(word):
        for n in range(longest, 0, -1):
            if word[i : i + n] in table:
                out.append(table[word[i : i + n]])
                i += n
                break
        else:
            out.append(word[i])
            i += 1
    return out


def _read_indic(word: str, start: int) -> list[int | str]:
    nv, nm = len(VOWEL_AT), len(MARK_AT)
    vowels = {start + o: i for i, o in enumerate(VOWEL_AT)}
    signs = {start + o: i for i, o in enumerate(SIGN_AT) if o}
    others = {start + o: nv + i for i, o in enumerate(MARK_AT)} | {start + o: nv + nm + i for i, o in enumerate(CONSONANT_AT)}
    word = word.replace(chr(start + 0x38) + chr(start + 0x3C), chr(start + 0x36))  # one letter has no composed form
    out: list[int | str] = []
    open_ = False  # a consonant that still carries its vowel
    for c in word:
        code = ord(c)
        if open_ and code not in signs and code != start + VIRAMA:
            out.append(0)
        if code in signs:
            out.append(signs[code])
        elif code in vowels:
            out.append(vowels[code])
        elif code in others:
            out.append(others[code])
        elif code != start + VIRAMA:
            digit = code - start - 0x66
            out.append(str(digit) if 0 <= digit <= 9 else c)
        open_ = code in others and others[code] >= nv + nm
    if open_:
        out.append(0)
    return out


def _write_indic(sounds: list[int | str], start: int) -> str:
    nv, nm = len(VOWEL_AT), len(MARK_AT)
    out, open_ = [], False
    for s in sounds:
        if isinstance(s, int) and s < nv:
            code = SIGN_AT[s] if open_ else VOWEL_AT[s]
            out.append(chr(start + code) if code else "")
            open_ = False
            continue
        if open_:
            out.append(chr(start + VIRAMA))
        open_ = isinstance(s, int) and s >= nv + nm
        out.append(s if isinstance(s, str) else chr(start + (MARK_AT[s - nv] if s < nv + nm else CONSONANT_AT[s - nv - nm])))
    return "".join(out) + (chr(start + VIRAMA) if open_ else "")


@lru_cache(64)
def _roman_pattern(source: str, target: str) -> tuple[re.Pattern | None, dict[str, str]]:
    """What finds the sounds that two Roman schemes spell differently, and their new spellings.

    Longer spellings come first.  Sounds that stay as they are take part only where one that changes could begin inside them.
    """
    table = {a: _sounds(target)[i] for a, i in _roman_table(source)[0].items()}
    begins = {a[0] for a, b in table.items() if a != b}
    listed = sorted((a for a, b in table.items() if a != b or len(a) > 1 and begins & set(a)), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, listed))) if listed else None, table


def convert(word: str | None, source: str, target: str) -> str | None:
    """One text from one scheme to another; names in any case; composed form in and out."""
    if word is None:
        return None
    source, target = source.upper(), target.upper()
    word = unicodedata.normalize("NFC", word)
    if source in ("IAST", "KOLKATA"):
        word = word.lower()
    if source in VOWELS and target in VOWELS:
        pattern, table = _roman_pattern(source, target)
        return pattern.sub(lambda m: table[m[0]], word) if pattern else word
    sounds = _read_roman(word, source) if source in VOWELS else _read_indic(word, INDIC[source])
    if target in VOWELS:
        return "".join(s if isinstance(s, str) else _sounds(target)[s] for s in sounds)
    return _write_indic(sounds, INDIC[target])


@pandas_udf(T.StringType())
def _convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, sources, targets in batches:
        yield pd.Series([None if t is None or s is None else convert(t, s, g) for t, s, g in zip(texts, sources, targets, strict=True)], dtype=object)


def transliterate(text: Column, target: str, source: str | None = None) -> Column:
    """A text in another scheme; the source is detected where none is named."""
    return _convert(text, F.lit(source) if source else detect_scheme(text), F.lit(target))


def slp1_to_iast(text: Column) -> Column:
    """The one-to-one scheme, in built-in functions: single letters, then the ones with two letters."""
    pairs = [(a, b) for a, b in zip(_sounds("SLP1"), _sounds("IAST"), strict=True) if a != b]
    single = [(a, b) for a, b in pairs if len(b) == 1]
    out = text
    # Aspirates and diphthongs first, to letters outside the scheme, as their plain parts are letters of it.
    double = [(a, b) for a, b in pairs if len(b) == 2]
    marks = "".join(chr(0xE000 + i) for i in range(len(double)))
    out = F.translate(out, "".join(a for a, _ in single + double), "".join(b for _, b in single) + marks)
    for mark, (_, b) in zip(marks, double, strict=True):
        out = F.replace(out, F.lit(mark), F.lit(b))
    return out


def to_iast(text: Column) -> Column:
    """Composed text in the working scheme; what is there already is left as it is."""
    scheme = detect_scheme(text)
    done = scheme.isin("IAST", "Kolkata") & ~text.rlike("[̀-ͯ]")
    # The function sees a null instead of a text that is done, as its arguments are made for every row.
    return F.when(done, text).otherwise(_convert(F.when(~done, text), scheme, F.lit("IAST")))
