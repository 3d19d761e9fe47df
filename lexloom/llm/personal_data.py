"""Personal data by exact patterns and a skip-chain conditional random field.

The patterns give the base spans.  The field decides about looser mentions (runs of digits with
separators, words with an at sign, spelled-out addresses), which are the nodes of one graph a document;
all other tokens cannot carry a label.  Neighbouring mentions share a chain potential, and each mention
shares a skip potential with an exact one of the same digits, the same last digits or the same address (or,
where there is none, with the first mention), however far away.  Loopy message passing until the messages
stand still then makes the labels of one entity agree over the document: a number written once as a
telephone number is found wherever it stands bare, before or after.

Trained here, piecewise, on generated sentences (``lessons``): node weights by softmax regression, edge
potentials from the label pairs on chain and skip edges.

Defined cases: a null text is empty and has no spans; equal rows get equal results; work and memory are
linear in a text's mentions, as each one has at most one skip edge a key; where messages swing for ever,
their steps are halved again and again, so that they end.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of the two number patterns begins where no digit stands before: looking there only keeps them linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().0-9/-]{0,3}[0-9])*")
_SPELLED = re.compile(r"([A-Za-z0-9._%+-]{1,64})\x20?[\[(]at[\])]\x20?([A-Za-z0-9-]{1,63})((?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,10})")
#: Fewest digits of a number that can be a mention.
LEAST_DIGITS = 7
#: Characters before a mention in which telling words are looked for.
CONTEXT = 40
TELLING = {
    "phone": ("tel", "phone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "whatsapp"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit"),
    "ip": ("ip", "host", "server", "addr", "address"),
    "email": ("mail", "email", "contact", "write", "correo", "courriel"),
    "none": ("order", "invoice", "isbn", "version", "ref", "no", "nr", "page", "id", "total", "serial"),
}
HALVE, STILL, DAMPING, KEEP_FROM = 50, 1e-5, 0.3, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the exact patterns, by kind as listed and then by start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append(("email", start, match.end()))
            done = match.end()
        else:
            done = at + 1  # no later match can begin at or before this sign
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, base kind or none) of all nodes, by place; loose ones that touch a base span are left out."""
    out = [(s, e, kind) for kind, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    loose = [m.span() for m in _LOOSE.finditer(text) if len(_digits(m[0])) >= LEAST_DIGITS]
    loose += [m.span() for m in _SPELLED.finditer(text)]
    i, reach = 0, -1
    for s, e in sorted(loose):
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= s:
            out.append((s, e, "none"))
            reach = max(reach, e)
    return sorted(out)


def _keys(text: str) -> list[str]:
    """What two mentions must share to be linked by a skip edge."""
    spelled = _SPELLED.fullmatch(text)
    if spelled:
        return ["@" + re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", f"{spelled[1]}@{spelled[2]}{spelled[3]}").lower()]
    if "@" in text:
        return ["@" + text.lower()]
    digits = _digits(text)
    return [digits, "~" + digits[-9:]] if len(digits) >= 9 else [digits]


def edges(text: str, nodes: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbouring mentions, and skip edges by common keys.

    A loose mention is linked to the last exact one before it, else to the first exact one behind it; only one
    without any is linked to the first such mention.  So no evidence of a key has more than two edges to go,
    and loose repeats do not outvote an exact mention, however many there are.
    """
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= CONTEXT]
    keyed: dict[str, list[int]] = {}
    for i, (s, e, _) in enumerate(nodes):
        for key in _keys(text[s:e]):
            keyed.setdefault(key, []).append(i)
    skip, settled = set(), set()
    for own in keyed.values():
        exact = [i for i in own if nodes[i][2] != "none"]
        hub = exact[0] if exact else None
        for i in own:
            if nodes[i][2] != "none":
                hub = i
            elif hub is not None:
                skip.add((min(hub, i), max(hub, i)))
                settled.add(i)
    for own in keyed.values():
        loose = [i for i in own if nodes[i][2] == "none" and i not in settled]
        skip.update((loose[0], i) for i in loose[1:])
    return chain, sorted(skip)


def node_features(text: str, start: int, end: int) -> np.ndarray:
    own, ahead = text[start:end], re.findall(r"\w+", text[max(0, start - CONTEXT) : start].lower())[-4:]
    digits = _digits(own)
    n = len(digits)
    yes = [
        True,
        "@" in own or "[at]" in own or "(at)" in own,
        own.startswith("+"),
        "(" in own,
        own.count(".") == 3,
        own.count("-") >= 2,
        " " in own,
        "/" in own,
        n <= 8,
        9 <= n <= 11,
        12 <= n <= 15,
        n == 16,
        n > 16,
        13 <= n <= 19 and luhn(digits),
    ]
    for words in TELLING.values():
        yes.append(any(w in ahead for w in words))
    return np.array(yes, float)


def lessons(n: int = 1500, seed: int = 11) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Generated texts with labelled mentions: exact, loosened, repeated and misleading ones."""
    rng = random.Random(seed)

    def number(k: int) -> str:
        return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(k - 1))

    def card() -> str:
        body = number(15)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def phone() -> tuple[str, list[str]]:
        a, b, c = number(3), number(3), number(4)
        return f"+1 ({a}) {b}-{c}", [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}{b}{c}"]

    filler = ["the", "of", "report", "und", "les", "para", "more", "text", "here", "is"]
    for _ in range(n):
        parts: list[tuple[str, str]] = []
        kind = rng.choice(["phone", "card", "email", "ip", "none", "none", "none"])
        if kind == "phone":
            full, loose = phone()
            if rng.random() < 0.6:
                parts += [("", full, "phone"), ("", rng.choice(loose), "phone")]
            else:
                parts += [(rng.choice(TELLING["phone"]) + " ", rng.choice(loose[:3]), "phone")]
        elif kind == "card":
            digits = card()
            grouped = " ".join(digits[i : i + 4] for i in range(0, 16, 4))
            parts += [("", rng.choice([digits, grouped]), "card"), ("", digits[:8] + "." + digits[8:], "card")]
        elif kind == "email":
            user, host = f"u{number(3)}", f"mail{number(2)}"
            parts += [("", f"{user}@{host}.org", "email"), ("", f"{user} [at] {host} [dot] org", "email")]
        elif kind == "ip":
            parts += [("", ".".join(str(rng.randint(1, 255)) for _ in range(4)), "ip")]
        else:
            lead = rng.choice([*TELLING["none"], *filler]) + " "
            parts += [(lead, number(rng.randint(7, 19)), "none")]
            if rng.random() < 0.5:
                parts += [(lead, parts[0][1], "none")]
            if rng.random() < 0.3:
                parts += [("", f"{number(4)}-{number(2)}-{number(2)}", "none")]
            if rng.random() < 0.3:
                parts += [("", f"{number(3)} {number(3)} {number(4)}", "none")]
            if rng.random() < 0.3:
                parts += [("", f"{number(3)}-{number(3)}-{number(4)}", "none")]
        text, marks = "", []
        for lead, body, label in parts:
            text += " ".join(rng.choice(filler) for _ in range(rng.randint(2, 12))) + " " + lead
            marks.append((len(text), len(text) + len(body), label))
            text += body + " "
        yield text + "end", marks


@lru_cache(1)
def field() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node weights, and the log potentials of chain and skip edges."""
    rows, truth = [], []
    pairs = np.full((2, len(LABELS), len(LABELS)), 1.0)
    for text, marks in lessons():
        nodes = mentions(text, base_spans(text))
        names = [next((m[2] for m in marks if m[0] < e and s < m[1]), "none") for s, e, _ in nodes]
        known = [LABELS.index(x) for x in names]
        for (s, e, base), label in zip(nodes, known, strict=True):
            if base == "none":
                rows.append(node_features(text, s, e))
                truth.append(label)
        for which, some in enumerate(edges(text, nodes)):
            for i, j in some:
                pairs[which, known[i], known[j]] += 1
                pairs[which, known[j], known[i]] += 1
    x, y = np.array(rows), np.eye(len(LABELS))[truth]
    weights = np.zeros((x.shape[1], len(LABELS)))
    for _ in range(400):
        p = np.exp(x @ weights)
        p /= p.sum(1, keepdims=True)
        weights += 1.0 * (x.T @ (y - p) / len(x) - 0.0005 * weights)
    chain, skip = (np.log(q / q.sum()) - np.log(np.outer(q.sum(1), q.sum(0)) / q.sum() ** 2) for q in pairs)
    return weights, np.clip(chain, -1, 1) * 0.5, np.clip(skip, -4, 4)


def beliefs(nodes: np.ndarray, pairs: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy message passing, damped, until no message moves by more than STILL.

    ``nodes``: log scores; ``pairs``: the two nodes of every edge; ``potentials``: log matrix of each edge.
    """
    n, k = nodes.shape
    if not len(pairs):
        out = np.exp(nodes - nodes.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)
    source = np.concatenate([pairs[:, 0], pairs[:, 1]])
    target = np.concatenate([pairs[:, 1], pairs[:, 0]])
    psi = np.exp(np.concatenate([potentials, potentials.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    sent = np.full((len(source), k), -np.log(k))
    step, moved, rounds = 1 - DAMPING, np.inf, 0
    while moved > STILL:
        total = nodes.copy()
        np.add.at(total, target, sent)
        x = total[source] - sent[back]
        y = np.log(np.einsum("eij,ei->ej", psi, np.exp(x - x.max(1, keepdims=True))) + 1e-300)
        y -= np.log(np.exp(y - y.max(1, keepdims=True)).sum(1, keepdims=True)) + y.max(1, keepdims=True)
        change = step * (y - sent)
        sent = sent + change
        moved, rounds = np.abs(change).max(), rounds + 1
        if rounds % max(HALVE, 2 * n) == 0:  # a message on a tree has arrived by then
            step /= 2
    total = nodes.copy()
    np.add.at(total, target, sent)
    out = np.exp(total - total.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: by kind as listed, then by start."""
    if not text or not _SOME.search(text):
        return [], []
    base = base_spans(text)
    nodes = mentions(text, base)
    if all(kind != "none" for _, _, kind in nodes):
        return base, base
    weights, chain, skip = field()
    # Exact mentions are observed: no number of loose ones can change what they say.
    observed = np.where(np.eye(len(LABELS)) > 0, 0.0, -np.inf)
    scores = np.stack(
        [
            node_features(text, s, e) @ weights if kind == "none" else observed[LABELS.index(kind)]
            for s, e, kind in nodes
        ]
    )
    near, far = edges(text, nodes)
    pairs = np.array([*near, *far], np.int64).reshape(-1, 2)
    potentials = np.concatenate([np.broadcast_to(chain, (len(near), *chain.shape)), np.broadcast_to(skip, (len(far), *skip.shape))])
    got = beliefs(scores, pairs, potentials)
    added = [
        (LABELS[g.argmax()], s, e)
        for (s, e, kind), g in zip(nodes, got, strict=True)
        if kind == "none" and g.argmax() and g.max() >= KEEP_FROM
    ]
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


_SOME = re.compile(r"[0-9@]|[\[(]at[\])]")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, digest of the base spans, all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([joined(both) for _, both in found], pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    )
