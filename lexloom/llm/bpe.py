"""Byte-pair encoding by automaton, and decoding by arc labels.

Compilation reads the merges in order.  The gadget of a merge (a, b) -> c takes the arc b away from the
states entered by a, and gives every state with an arc a (and b behind it) an arc c that leads where b
led.  So a state is known by the token that enters it, and what the gadgets did to a pair of states is
fixed by two chains: the tokens that ended the left one and the tokens that began the right one, each
with the merge that made it.  ``Automaton`` keeps these chains (the gadgets in factored form) instead of
|V| x |V| arcs, and makes arcs on demand.

Encoding walks a table of byte transitions.  Its states hold the longest read suffix that begins some
token and the last token at each place of it: all that later arcs depend on.  States and transitions are
made on first use and then only looked up; the table is emptied when it is full, as a cache.

Defined cases: a null text is empty and gives no tokens; special tokens' strings become their ids, as
the library does by default; the table and the cache of words have fixed sizes, so memory is bounded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import END, LETTER, SPACE, classes, code_points, cuts, joined_text, prefix_hashes, run_hashes, slices, spread

NEVER = 1 << 40
#: Most states of the transition table, and most words of the cache of a worker.
MOST_STATES, MOST_WORDS = 200_000, 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Token automaton of a byte-level vocabulary, and the byte transitions that encode with it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels: dict[int, bytes] = {
            i: bytes(as_byte[c] for c in t) for t, i in vocab.items() if t not in self.specials
        }
        self.labels |= {i: t.encode() for t, i in self.specials.items()}
        #: token -> (merge that makes it, its left part, its right part); bytes are there from the start.
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, -1, -1) for t, i in vocab.items() if len(t) == 1}
        self.rank: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.by_label: dict[bytes, int] = {self.labels[i]: i for i in self.made}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(rank, vocab[left], vocab[right], vocab[left + right])
        self.begins = {label[:k] for label in self.by_label for k in range(1, len(label))}
        self._empty()

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        """Add one merge.  A token that earlier merges keep from ever being read whole gets no arc."""
        self.rank.setdefault((a, b), rank)
        if c not in self.made and a in self.made and b in self.made and self._adjacent(a, b, rank):
            self.made[c] = (rank, a, b)
            self.by_label[self.labels[c]] = c

    def _chain(self, token: int, side: int, until: int) -> list[tuple[int, int]]:
        """(token, merge that takes it up) from the outermost byte to ``token``, at the left or right edge."""
        out = []
        while token >= 0:
            out.append((token, until))
            until, *parts = self.made[token]
            token = parts[side]
        return out[::-1]

    def _adjacent(self, x: int, y: int, until: int = NEVER) -> bool:
        """Whether no gadget before ``until`` took the arc y away from the state of x.

        Both edges grow as merges are applied; a merge across the boundary that comes before the edges'
        next growth removes the arc.  Equal merges go from left to right.
        """
        left, right = self._chain(x, 1, until), self._chain(y, 0, until)
        i = j = 0
        while True:
            (u, u_end), (v, v_end) = left[i], right[j]
            across = self.rank.get((u, v), NEVER)
            if across < u_end and (across <= v_end if v_end < until else across < v_end):
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if j + 1 == len(right) or i + 1 < len(left) and u_end <= v_end:
                i += 1
            else:
                j += 1

    def arc(self, x: int, y: int) -> bool:
        ok = self.arcs.get((x, y))
        if ok is None:
            if len(self.arcs) >= 4 * MOST_STATES:
                self.arcs.clear()
            ok = self.arcs[x, y] = self._adjacent(x, y)
        return ok

    def _empty(self) -> None:
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self.numbers = {self.states[0]: 0}
        self.last = [-1]
        self.table: dict[int, int] = {}

    def _step(self, state: int, byte: int) -> int:
        suffix, tokens = self.states[state]
        suffix += bytes([byte])
        for k in range(len(suffix)):
            token = self.by_label.get(suffix[k:])
            if token is not None and (tokens[k] < 0 or self.arc(tokens[k], token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        tokens += (token,)
        k = 0
        while k < len(suffix) and suffix[k:] not in self.begins:
            k += 1
        key = (suffix[k:], tokens[k:])
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.last.append(token)
        self.table[state << 8 | byte] = number
        return number

    def encode_word(self, word: bytes) -> list[int]:
        if len(self.states) > MOST_STATES:
            self._empty()
        state, table, last, read = 0, self.table, self.last, []
        for byte in word:
            after = table.get(state << 8 | byte)
            state = self._step(state, byte) if after is None else after
            read.append(last[state])
        out, i = [], len(word)
        while i:
            out.append(read[i - 1])
            i -= len(self.labels[read[i - 1]])
        return out[::-1]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


def split_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-split words, for codes with a break at either end.

    The rule is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|S+(?!\\S)|S+`` with the classes of ``arrays``:
    runs of a class; a single blank joins the run behind it; what is left of a white run is a word, and
    so is its last character where that is no blank and a run follows; a lone apostrophe that no blank
    joins takes a known ending of two or three letters away from the run behind it.
    """
    kind = classes(codes)
    starts = np.zeros(len(codes) + 1, bool)
    starts[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    follows = np.zeros(len(codes), bool)
    follows[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END)
    starts[:-1] |= follows  # the last white character before a run begins a word
    joins = np.flatnonzero(follows & (codes == 32))
    starts[joins + 1] = False
    quote = np.flatnonzero((codes[1:-1] == 39) & starts[1:-2] & starts[2:-1] & (kind[2:] == LETTER)) + 1
    _endings(codes, quote, starts)
    at = np.flatnonzero(starts[:-1] & (kind != END))
    ends = np.flatnonzero(starts[1:-1] | (kind[1:] == END)) + 1
    return at, ends[np.searchsorted(ends, at, "right")]


def _endings(codes: np.ndarray, quote: np.ndarray, starts: np.ndarray) -> None:
    """Let each of the given apostrophes take its ending, where one of the known ones follows."""
    if not len(quote):
        return
    one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long_ = np.zeros(len(quote), bool)
    for pair in ("re", "ve", "ll"):
        long_ |= (one == ord(pair[0])) & (two == ord(pair[1]))
    for q, n in ((quote[short], 2), (quote[long_ & ~short], 3)):
        starts[q + 1] = False
        starts[q + n] = True


class WordCache:
    """Token ids of words by the words' hashes, in flat arrays; emptied when full."""

    def __init__(self, encode):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.starts, self.counts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _add(self, keys: list[int], words: list[str]) -> None:
        found = self.encode(words)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        n, k = len(self.slots), self.used
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        while k + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(keys) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.ids[k : k + len(flat)] = flat
        self.counts[n : n + len(keys)] = counts
        self.starts[n : n + len(keys)] = k + np.cumsum(counts) - counts
        self.slots.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used = k + len(flat)

    def encode_runs(self, joined: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all runs, and each run's number of them."""
        keys = run_hashes(prefix_hashes(codes), starts, ends)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.slots) + len(distinct) > MOST_WORDS:
            self._empty()
        known = distinct.tolist()
        new = [i for i, k in enumerate(known) if k not in self.slots]
        if new:
            at = first[new]
            self._add([known[i] for i in new], [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        slots = np.fromiter(map(self.slots.__getitem__, known), np.int64, len(known))[which]
        counts = self.counts[slots]
        return self.ids[spread(self.starts[slots], counts)], counts


class Codec:
    """Encodes lists of texts; one for each worker and vocabulary file."""

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.automaton.specials)) + ")")
        encode = self.automaton.encode_word
        self.cache = WordCache(lambda words: [encode(w.encode("utf-8", "surrogatepass")) for w in words])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        odd = {i: t for i, t in enumerate(texts) if t and "<|" in t and self.special.search(t)}
        out = self._plain([None if i in odd else t for i, t in enumerate(texts)])
        for i, t in odd.items():
            parts = self.special.split(t)
            plain = iter(self._plain(parts[::2]))
            out[i] = np.concatenate(
                [np.array([self.automaton.specials[p]], np.uint32) if k % 2 else next(plain) for k, p in enumerate(parts)]
            )
        return out

    def _plain(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in cuts(texts):
            joined = joined_text(texts[a:b])
            codes, at = code_points(texts[a:b], joined)
            starts, ends = split_words(codes)
            ids, counts = self.cache.encode_runs(joined, codes, starts, ends)
            total = np.concatenate([[0], np.cumsum(counts)])
            out += np.split(ids, total[np.searchsorted(starts, at[1:-1])])
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id (as a long), n_tokens, ids_sha256, decoded_sha256: one row for each row.

    A null text is empty and has no tokens; a null doc_id is carried; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for part in (p for batch in batches for p in slices(batch, 1)):
            tokens = made.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t) for t in tokens], pa.int64()),
                    pa.array([hashlib.sha256(t.astype("<u4").tobytes()).hexdigest() for t in tokens], pa.string()),
                    pa.array([hashlib.sha256(made.automaton.decode(t).encode()).hexdigest() for t in tokens], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
