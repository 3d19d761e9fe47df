"""Texts as flat arrays: code points, runs of a class, 64-bit hashes of runs.

Work on whole batches with array operations; a batch is cut so that its arrays stay small, and only a
single longer text makes a longer cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of one cut, unless one text has more.
CUT = 1 << 20
#: Texts of one cut.
CUT_TEXTS = 1 << 15
#: Stands between texts; no character has this number.
BREAK = 0x110000
_P = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(texts: list[str | None], most: int = CUT) -> Iterator[tuple[int, int]]:
    """Ranges of texts with ``most`` code points or so, and CUT_TEXTS texts, each."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (total + n > most or i - start == CUT_TEXTS):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, column: int, most: int = CUT) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``most`` bytes of text or so, and CUT_TEXTS rows: only one part's texts are Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start == CUT_TEXTS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def joined_text(texts: list[str | None]) -> str:
    """All texts in one, at the places that ``code_points`` gives their characters."""
    return "\n" + "\n".join([t or "" for t in texts]) + "\n"


def code_points(texts: list[str | None], joined: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a BREAK before the first text and after each; and the places of the breaks."""
    flat = [t or "" for t in texts]
    joined = joined_text(flat) if joined is None else joined
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    at = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1, out=at[1:])
    codes[at] = BREAK
    return codes, at


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the first and last element must be False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    values = mix(codes.astype(np.uint64) * _P + np.uint64(0x632BE59BD9B4E019))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * _power(len(codes))[0][: len(codes)], out=out[1:])
    return out


def run_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run's code points, the same wherever the run stands."""
    return mix((prefix[ends] - prefix[starts]) * _power(len(prefix))[1][starts])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of them; the largest table for usual cuts is kept."""
    for size, known in _powers.items():
        if size >= n:
            return known
    size = 1 << max(16, (n - 1).bit_length())
    both = []
    for base in (_P, _INVERSE):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    if size <= CUT * 2:
        _powers.clear()
        _powers[size] = (both[0], both[1])
    return both[0], both[1]


def is_word(codes: np.ndarray) -> np.ndarray:
    """Where a character of a word ``[^\\x20\\x09-\\x0D]+`` stands."""
    return (codes != 32) & (codes - np.uint32(9) > 4) & (codes != BREAK)


LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 4, 5
_classes: list[np.ndarray] = []


def classes(codes: np.ndarray) -> np.ndarray:
    """LETTER (L*), NUMBER (N*), SPACE (White_Space), OTHER or END (a break) of each code point."""
    if not _classes:
        table = np.full(BREAK + 1, OTHER, np.uint8)
        for c in range(BREAK):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                table[c] = LETTER
            elif kind[0] == "N":
                table[c] = NUMBER
        for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            table[c] = SPACE
        table[BREAK] = END
        _classes.append(table)
    return _classes[0][codes]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
