"""Best-fit packing of token sequences by exact complements.

Documents are tokenised, closed with one end id, and cut into pieces of at most the sequence length.
Only the number of pieces of each length (at most as many rows as the sequence is long, whatever the
input) is planned: single, then pair, then triple sums that exactly fill a piece's gap are taken from the
counts for as many sequences as the counts allow at once; what no sum fills goes, by descending length,
to the open sequences with the least room that is enough.  The plan is a list of
patterns with multiplicities.  A piece finds its place from its number among the pieces of its length,
counted per partition and offset by prefix sums, so no length, however common, meets in one task.

Defined cases: a null or empty text gives one piece with the end id alone; a null doc_id is carried;
equal rows are packed as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrays import END, LETTER, NUMBER, OTHER, classes, code_points, cuts, joined_text, slices
from .bpe import WordCache, _endings
from .common import released, small_batches, stored

LIMIT, END_ID = 2048, 0
#: Bytes of text that are tokenised at a time.
CUT_AT = 1 << 18


def lower_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ``'s|'t|'re|'ve|'m|'ll|'d|L+|N|O+``; white space is no part of any word."""
    kind = classes(codes)
    starts = np.zeros(len(codes) + 1, bool)
    starts[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == END)
    quote = np.flatnonzero((codes[1:-1] == 39) & starts[1:-2] & starts[2:-1] & (kind[2:] == LETTER)) + 1
    _endings(codes, quote, starts)
    inside = (kind == LETTER) | (kind == NUMBER) | (kind == OTHER)
    at = np.flatnonzero(starts[:-1] & inside)
    edges = np.flatnonzero(starts[1:-1] | (kind[1:] == END)) + 1
    return at, edges[np.searchsorted(edges, at, "right")]


class LowerCodec:
    """Ids of the lower-casing word vocabulary: words are split here, the library encodes each new one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer = tokenizer
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added)))
        self.model = tokenizer.model
        self.cache = WordCache(self._words)

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of lower-case words.  Printable ASCII stands for itself in the byte alphabet, so the merges alone are asked for it."""
        out: list[list[int]] = [[]] * len(words)
        other = []
        for i, w in enumerate(words):
            if w.isascii() and w.isprintable():
                out[i] = [t.id for t in self.model.tokenize(w)]
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in cuts(texts):
            part = [_normal(t) for t in texts[a:b]]
            odd = {i: texts[a + i] for i, t in enumerate(texts[a:b]) if t and "<|" in t and self.special.search(t)}
            for i in odd:
                part[i] = ""
            joined = joined_text(part)
            codes, at = code_points(part, joined)
            starts, ends = lower_words(codes)
            ids, counts = self.cache.encode_runs(joined, codes, starts, ends)
            total = np.concatenate([[0], np.cumsum(counts)])
            found = np.split(ids, total[np.searchsorted(starts, at[1:-1])])
            for i, t in odd.items():  # special tokens stand in the raw text: the library does it all
                found[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            out += found
        return out


def _normal(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # each character by itself: no final form of sigma
            return "".join(c.lower() for c in text)
    return text.lower()


@lru_cache(2)
def codec(path: str) -> LowerCodec:
    return LowerCodec(path)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        end = np.array([END_ID], np.uint32)
        for part in (p for batch in batches for p in slices(batch, 1, CUT_AT)):
            row, piece, start, length, crc = [], [], [], [], []
            for i, tokens in enumerate(made.encode(part.column(1).to_pylist())):
                tokens = np.concatenate([tokens, end]).astype("<u4")
                for k, s in enumerate(range(0, len(tokens), limit)):
                    own = tokens[s : s + limit]
                    row.append(i), piece.append(k), start.append(s)
                    length.append(len(own)), crc.append(zlib.crc32(own.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        released(run), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


Plan = list[tuple[tuple[int, ...], int]]


def plan(counts: dict[int, int], limit: int = LIMIT) -> Plan:
    """Patterns of lengths, each with the number of sequences that hold it; all pieces are placed once.

    Sums of one, of up to two and of up to three pieces are tried as far as they go, each with best fit
    for the rest, and the plan of fewest sequences is kept: planning sees counts only, so trying is cheap.
    """
    return min((_planned(counts, limit, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _planned(counts: dict[int, int], limit: int, most: int) -> Plan:
    """All single sums first, from the longest length down, then all pairs, then all triples; then best fit."""
    left = {x: n for x, n in counts.items() if n}
    live, sums = sorted(left), Sums(left, limit)
    out: Plan = []
    for parts in range(most + 1):
        half = bisect_left(live, limit // 2 + 1)
        # Pairs and triples go first to lengths just over half, which would waste most; then to shorter ones.
        for top in live[::-1] if parts < 2 else live[half:] + live[:half][::-1]:
            while left.get(top):
                gap = limit - top
                if parts == 0 or gap == 0:
                    found = () if gap == parts == 0 else None
                else:
                    found = (sums.single, sums.pair, sums.triple)[parts - 1](gap, (top,))
                if found is None:
                    break
                pattern = (top, *found)
                n = min(left[x] // pattern.count(x) for x in set(pattern))
                out.append((pattern, n))
                for x in pattern:
                    left[x] -= n
                for x in set(pattern):
                    if not left[x]:
                        live.pop(bisect_left(live, x))
                        del left[x]
    return out + best_fit(sorted(left.items()), limit)


class Sums:
    """Single, pair and triple sums of the available lengths, indexed by their total.

    The pairs of a total are listed once, the larger part first and falling.  Counts only fall, so a pair
    that has run out is passed for good; triples are a length and an indexed pair of the rest.
    """

    def __init__(self, left: dict[int, int], limit: int):
        self.left = left
        self.there = np.zeros(limit + 1, bool)
        self.there[[x for x in left if x <= limit]] = True
        self.pairs: dict[int, np.ndarray] = {}
        self.passed: dict[int, int] = {}

    def single(self, total: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if self._enough((total,), used) else None

    def pair(self, total: int, used: tuple[int, ...], most: int | None = None) -> tuple[int, ...] | None:
        """The pair of that sum with the largest part (``most`` at most), of what ``used`` leaves."""
        if total not in self.pairs:
            first = np.arange(total - 1, (total - 1) // 2, -1)
            first = first[first < len(self.there)]
            self.pairs[total] = first[self.there[first] & self.there[total - first]].astype(np.int32)
            self.passed[total] = 0
        listed, at = self.pairs[total], self.passed[total]
        while at < len(listed) and not self._enough((int(listed[at]), total - int(listed[at])), ()):
            at += 1
        self.passed[total] = at
        if most is not None:
            at = max(at, int(np.searchsorted(-listed, -most)))
        for a in listed[at:].tolist():
            if self._enough((a, total - a), used):
                return a, total - a
        return None

    def triple(self, total: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        first = np.flatnonzero(self.there[: max(total - 1, 0)])[::-1]
        for a in first[3 * first >= total].tolist():
            if self._enough((a,), used):
                rest = self.pair(total - a, (*used, a), a)
                if rest:
                    return a, *rest
        return None

    def _enough(self, parts: tuple[int, ...], used: tuple[int, ...]) -> bool:
        return all(self.left.get(x, 0) >= parts.count(x) + used.count(x) for x in parts)


def best_fit(pieces_left: list[tuple[int, int]], limit: int) -> Plan:
    """Best fit by descending length, whole groups of equal sequences at a time."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = limit - sum(pattern)
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for length, n in sorted(pieces_left, reverse=True):
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = limit // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            room = rooms[i]
            pattern, there = next(iter(open_[room].items()))
            each = min(room // length, n)
            used = min(there, n // each)
            open_[room][pattern] -= used
            if open_[room][pattern] == 0:
                del open_[room][pattern]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            n -= used * each
            put(pattern + (length,) * each, used)
    return [(p, n) for group in open_.values() for p, n in group.items()]


def _slots(made: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first number served by each of its slots, the slot's first sequence, and place."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    served: dict[int, int] = {}
    base = 0
    for pattern, n in made:
        place = 0
        for x in pattern:
            slots.setdefault(x, []).append((served.get(x, 0), base, place))
            served[x] = served.get(x, 0) + n
            place += x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in slots.items()}


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, path, limit).withColumn("part", F.spark_partition_id()), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= limit rows
    slots = _slots(plan(counts, limit))
    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        cut.withColumn("number", F.row_number().over(inside))
        .join(offsets, ["part", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("number") - 1).alias("number"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(group):
                    first, base, at = slots[int(length[group[0]])]
                    i = np.searchsorted(first, number[group], "right") - 1
                    sequence[group], offset[group] = base[i] + number[group] - first[i], at[i]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
