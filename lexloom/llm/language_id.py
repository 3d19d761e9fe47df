"""Language identification by a linear-chain conditional random field over words.

Every run of letters is a word with affix, n-gram and lexicon (whole-word) features, hashed into a
fixed table of weights; learned transitions tie neighbouring words.  Forward-backward gives each word's
label probabilities, also where a text switches languages; a document gets the label with the highest
mean probability, and that mean as its score.

Learned from a bounded sample of labelled rows: at most LANG_DOCS documents a language (the ones with the
least hash in each of LANG_DOCS hash classes), TOTAL_DOCS in all, of the MOST_LANGS commonest languages.
Their texts, and those that are labelled, are read whole; the work memory of a training step is bounded.

Defined cases: a null text or one without letters is ``und`` with score 0, and so is every text where no
label can be learned; a null doc_id is not held out and not learned from; repeated rows get equal results;
an empty table gives an empty one; other columns pass ``keep_known`` as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LETTER, classes, code_points, cuts, mix, prefix_hashes, run_hashes, runs, slices, spread
from .common import released, stored

LANG_DOCS, TOTAL_DOCS, MOST_LANGS = 256, 4096, 256
BUCKETS = 1 << 15
#: Words of a training sequence, of a block of the chain; training rounds and step.
SEQUENCE, BLOCK, EPOCHS, BATCH, STEP = 40, 32, 3, 64, 0.4
#: Code points of the texts that are learned from at a time: the driver's memory is bounded by it.
LEARNED_AT_ONCE = 1 << 17
#: Code points of the texts that are labelled at a time.
LABELLED_AT_ONCE = 1 << 19
UNKNOWN = "und"


def features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight-table places of all features, word after word, and each word's number of them."""
    prefix = prefix_hashes(codes)
    length = ends - starts
    words = np.arange(len(starts))
    place, owner = [], []

    def add(tag: int, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> None:
        place.append((mix(run_hashes(prefix, a, b) + np.uint64(tag * 0x9E37)) % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(own)

    add(1, starts, ends, words)
    for n in (1, 2, 3):
        long_ = length >= n
        add(1 + n, starts[long_], starts[long_] + n, words[long_])
        add(4 + n, ends[long_] - n, ends[long_], words[long_])
    for n in (2, 3):
        count = np.maximum(length - n + 1, 0)
        at = spread(starts, count)
        add(7 + n, at, at + n, np.repeat(words, count))
    own = np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return np.concatenate(place)[order], np.bincount(own, minlength=len(starts))


def words_in(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, starts and ends of the words, and the text of each word."""
    codes, at = code_points([t.lower() if t else "" for t in texts])
    starts, ends = runs(classes(codes) == LETTER)
    return codes, starts, ends, np.searchsorted(at, starts) - 1


class Chain:
    """Weights of the field: of features and labels, of starts, and of pairs of labels."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.first, self.pairs = np.zeros(k), np.zeros((k, k))

    def scores(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sum of the feature weights of each word and label."""
        if not len(count):
            return np.zeros((0, len(self.labels)))
        return np.add.reduceat(self.weights[place], np.cumsum(count) - count).astype(np.float64)

    def fit(self, texts: list[str], names: list[str]) -> None:
        """Stochastic gradient steps on the log likelihood of sequences of up to SEQUENCE words.

        A third of the sequences join pieces of two documents, so that transitions between labels are
        learned too.  Texts go through in cuts, in a drawn order, so memory is that of one cut.
        """
        rng = np.random.default_rng(20)
        squares = [np.full_like(x, 1e-6, dtype=np.float64) for x in (self.weights, self.first, self.pairs)]
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            shuffled = [texts[i] for i in order]
            truth = np.array([self.labels.index(names[i]) for i in order], np.int64)
            for a, b in cuts(shuffled, LEARNED_AT_ONCE):
                self._learn(shuffled[a:b], truth[a:b], rng, squares)

    def _learn(self, texts: list[str], truth: np.ndarray, rng: np.random.Generator, squares: list[np.ndarray]) -> None:
        """One pass over the texts of a cut."""
        codes, starts, ends, doc = words_in(texts)
        if not len(doc):
            return
        place, count = features(codes, starts, ends)
        offset, truth, half = np.cumsum(count) - count, truth[doc], SEQUENCE // 2
        # Pieces of half a sequence; the last one of a text may be shorter.
        within = np.arange(len(doc)) - np.searchsorted(doc, doc)
        begin = np.flatnonzero(within % half == 0)
        size = np.diff(np.append(begin, len(doc)))
        follows = np.append(doc[begin[1:]] == doc[begin[:-1]], False)
        mate = np.where(follows, np.arange(len(begin)) + 1, np.arange(len(begin)))
        mixed = rng.random(len(begin)) < 1 / 3
        mate[mixed] = rng.integers(0, len(begin), int(mixed.sum()))
        both = np.where(mate == np.arange(len(begin)), 0, size[mate])  # a piece without a mate stands alone
        order = rng.permutation(len(begin))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            n = size[rows] + both[rows]
            words = np.zeros((len(rows), n.max()), np.int64)
            there = np.arange(n.max()) < n[:, None]
            first = np.arange(n.max()) < size[rows][:, None]
            words[first] = spread(begin[rows], size[rows])
            words[there & ~first] = spread(begin[mate[rows]], both[rows])
            flat = words[there]
            at = place[spread(offset[flat], count[flat])]
            emit = np.zeros((*words.shape, len(self.labels)))
            emit[there] = self.scores(at, count[flat])
            got, pairs = self._expected(emit, there)
            gold = truth[words]
            wrong = -got
            np.put_along_axis(wrong, gold[:, :, None], 1 + np.take_along_axis(wrong, gold[:, :, None], 2), 2)
            moved, linked = -pairs, there[:, 1:]
            np.add.at(moved, (gold[:, :-1][linked], gold[:, 1:][linked]), 1)
            push = np.zeros_like(squares[0])
            np.add.at(push, at, np.repeat(wrong[there], count[flat], 0))
            for x, g, s in zip((self.weights, self.first, self.pairs), (push, wrong[:, 0].sum(0), moved), squares, strict=True):
                g = g / len(rows)
                s += g * g
                x += (STEP * g / np.sqrt(s)).astype(x.dtype) * 0.1

    def _expected(self, emit: np.ndarray, there: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word, and expected label pairs, of sequences; ``there``: where their words stand."""
        e = np.exp(emit - emit.max(2, keepdims=True))
        a = np.exp(self.pairs - self.pairs.max())
        n, t, k = e.shape
        there = np.ones((n, t), bool) if there is None else there
        ahead, back = np.empty_like(e), np.ones_like(e)
        x = np.exp(self.first - self.first.max()) * e[:, 0]
        ahead[:, 0] = x / x.sum(1, keepdims=True)
        for i in range(1, t):
            x = (ahead[:, i - 1] @ a) * e[:, i]
            ahead[:, i] = np.where(there[:, i, None], x / x.sum(1, keepdims=True), ahead[:, i - 1])
        for i in range(t - 2, -1, -1):
            x = (back[:, i + 1] * e[:, i + 1]) @ a.T
            back[:, i] = np.where(there[:, i + 1, None], x / x.sum(1, keepdims=True), back[:, i + 1])
        got = ahead * back * there[:, :, None]
        got /= np.maximum(got.sum(2, keepdims=True), 1e-300)
        pair = ahead[:, :-1, :, None] * a * (e * back)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        return got, (pair * there[:, 1:, None, None]).sum((0, 1))

    def marginals(self, emit: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Label probabilities of every word of many texts of any length, by forward-backward.

        Each text is cut into blocks of BLOCK words.  The products of the blocks' transfer matrices are
        made for all blocks together, carried from block to block, and then the words inside all
        blocks are done together: exact, with steps as many as a block has words and a text blocks.
        """
        k = emit.shape[1]
        per = np.bincount(doc)
        per = per[per > 0]
        blocks = -(-per // BLOCK)
        total = int(blocks.sum())
        first_block = np.cumsum(blocks) - blocks
        begin = np.cumsum(per) - per
        slot = np.arange(len(doc)) - np.repeat(begin, per) + np.repeat(first_block * BLOCK, per)
        e = np.ones((total * BLOCK, k))
        e[slot] = np.exp(emit - emit.max(1, keepdims=True))
        there = np.zeros(total * BLOCK, bool)
        there[slot] = True
        e, there = e.reshape(total, BLOCK, k), there.reshape(total, BLOCK)
        a = np.exp(self.pairs - self.pairs.max())
        opening = np.zeros(total, bool)
        opening[first_block] = True
        start = np.exp(self.first - self.first.max())
        # In front of a text stands a row vector that its first matrix takes to the start weights.
        lead = np.broadcast_to(a, (total, k, k)).copy()
        lead[opening] = np.diag(start)
        product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for i in range(BLOCK):
            step = (product @ (lead if i == 0 else a)) * e[:, i, None, :]
            step /= step.max((1, 2), keepdims=True)
            product = np.where(there[:, i, None, None], step, product)
        into, out = np.ones((total, k)), np.ones((total, k))
        for b in range(1, int(blocks.max())):
            at = first_block[blocks > b] + b
            x = np.einsum("nk,nkj->nj", into[at - 1], product[at - 1])
            into[at] = x / x.sum(1, keepdims=True)
        for b in range(int(blocks.max()) - 2, -1, -1):
            at = first_block[blocks > b + 1] + b
            x = np.einsum("nkj,nj->nk", product[at + 1], out[at + 1])
            out[at] = x / x.sum(1, keepdims=True)
        ahead, x = np.empty_like(e), into
        for i in range(BLOCK):
            y = (np.einsum("nk,nkj->nj", x, lead) if i == 0 else x @ a) * e[:, i]
            y /= y.sum(1, keepdims=True)
            x = np.where(there[:, i, None], y, x)
            ahead[:, i] = x
        x = out
        for i in range(BLOCK - 1, -1, -1):
            ahead[:, i] *= x
            y = (e[:, i] * x) @ a.T
            y /= y.sum(1, keepdims=True)
            x = np.where(there[:, i, None], y, x)
        got = ahead.reshape(-1, k)[slot]
        return got / got.sum(1, keepdims=True)

    def label_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words, and the text each stands in."""
        codes, starts, ends, doc = words_in(texts)
        if not len(starts):
            return np.zeros((0, len(self.labels))), doc
        keys = run_hashes(prefix_hashes(codes), starts, ends)
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        emit = self.scores(*features(codes, starts[one], ends[one]))[which]
        return self.marginals(emit, doc), doc

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        got, doc = self.label_words(texts)
        n = np.bincount(doc, minlength=len(texts))
        mean = np.stack([np.bincount(doc, got[:, j], len(texts)) for j in range(got.shape[1])], 1) / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        names = [self.labels[b] if m else UNKNOWN for b, m in zip(best, n, strict=True)]
        return names, np.clip(np.where(n > 0, mean.max(1), 0.0), 0.0, 1.0)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> Chain:
    """The field, from the bounded sample of labelled rows that are not held out."""
    pool = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(8))
    picked = stored(
        pool.filter(F.col("text").isNotNull())
        .groupBy("lang", F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(LANG_DOCS)).alias("part"))
        .agg(F.min_by("doc_id", hashed).alias("doc_id"), F.count("*").alias("rows")),
        "language-rows",
    )
    langs = [r["lang"] for r in picked.groupBy("lang").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()]
    each = TOTAL_DOCS // max(len(langs), TOTAL_DOCS // LANG_DOCS)
    picked = picked.filter(F.col("lang").isin(langs) & (F.col("part") < each)).select("lang", "doc_id")
    # At most TOTAL_DOCS rows are broadcast, and that many texts collected.
    rows = pool.join(F.broadcast(picked), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    chain = Chain(sorted({r["lang"] for r in rows}))
    chain.fit([r["text"] for r in rows], [r["lang"] for r in rows])
    return chain


def _predictor(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, batch.num_columns - 1, LABELLED_AT_ONCE)):
            names, score = chain.predict(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())],
                names=[*part.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document."""
    chain = learn(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        released(_predictor(chain)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    )


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without the rows that have no letters or no label of at least that mean probability."""
    chain = learn(docs)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.fieldNames().index("text")
        for part in (p for batch in batches for p in slices(batch, at, LABELLED_AT_ONCE)):
            names, score = chain.predict(part.column(at).to_pylist())
            good = [n != UNKNOWN and s >= least for n, s in zip(names, score.tolist(), strict=True)]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(released(run), schema)
