"""MinHash near-dedup with SuperMinHash signatures, banding, full verification and union-find grouping.

A document's set holds its distinct two-word shingles.  Equal sets form a class at once, by digest, and
one class member stands for all.  Signatures of the representatives are banded; in every bucket the
members are tested against a centre (the smallest id), on full sets, and then the members outside the
bucket's largest component against a drawn member of that one.  Buckets whose members still lie in several
components are settled exactly: among their members, pairs of different components are tested wherever a
common shingle stands so early in both (rarest first) that a similarity of 0.8 is possible.  So a bucket of
one group of copies costs a star, however large it is; documents that share a common passage and little
else are never paired, however many they are; and no pair of a bucket that could join two components is
left out.  Two sets at the threshold miss all buckets with a probability of 5e-6.

Defined cases: texts that are null, empty or without words have an empty set and are linked with
nothing; rows with a null doc_id are linked with nothing and kept; rows of equal doc_id are one node of
the graph, also if their texts differ; equal rows are one class; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import code_points, is_word, mix, prefix_hashes, run_hashes, runs, slices
from .common import drop_stored, released, small_batches, spread_join, stored

BANDS, ROWS = 40, 6
SLOTS = BANDS * ROWS
#: Similarity that links, as a fraction.
SHARE, OF = 80, 100
#: Keys that hold more than one in so many of a table's rows are joined by broadcast; there are no more of them.
HOT_KEYS = 1000
#: Code points of one cut: signatures need some 60 bytes a code point for it.
CUT_AT = 1 << 18
#: From this level on, permutations are kept as rows and not as lists of swaps.
ROWS_FROM = 6


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one after another, and each text's count."""
    n = len(texts)
    codes, at = code_points(texts)
    codes += np.uint32(32) * ((codes >= 65) & (codes <= 90))
    starts, ends = runs(is_word(codes))
    words = run_hashes(prefix_hashes(codes), starts, ends)
    doc = np.searchsorted(at, starts) - 1
    pair = doc[1:] == doc[:-1]
    two = mix(words[:-1][pair] * np.uint64(0xD6E8FEB86659FD93) + mix(words[1:][pair]))
    per = np.bincount(doc, minlength=n)
    alone = per[doc] == 1
    found = np.concatenate([two, mix(words[alone] + np.uint64(0x2545F4914F6CDD1D))])
    owner = np.concatenate([doc[1:][pair], doc[alone]])
    order = np.argsort(found)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    found, owner = found[order], owner[order]
    if len(found):
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
        found, owner = found[new], owner[new]
    return found, np.bincount(owner, minlength=n)


def super_minhash(sets: np.ndarray, counts: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` values (level and fraction in one uint32) for each set.

    Level j gives every element its j-th place in a permutation of its own and the value j + r.  All
    elements go through a level together; a set stops before level j once no slot holds j or more, for
    then no later value can be smaller.
    """
    n = len(counts)
    out = np.full(n * m, 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(n), counts)
    swaps: list[np.ndarray] = []
    moved: list[np.ndarray] = []
    rows = None
    for j in range(m):
        if j:
            open_ = (out.reshape(n, m) >= np.uint32(j << 24)).any(1)
            keep = open_[owner]
            if not keep.any():
                break
            if not keep.all():
                owner, sets = owner[keep], sets[keep]
                swaps, moved = [x[keep] for x in swaps], [x[keep] for x in moved]
                rows = rows[keep] if rows is not None else None
        drawn = mix(sets * np.uint64(0x9E3779B97F4A7C15) + np.uint64((j + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
        k = (j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)).astype(np.uint8)
        value = np.uint32(j << 24) + (drawn >> np.uint64(40)).astype(np.uint32)
        if j == ROWS_FROM:
            rows = np.tile(np.arange(m, dtype=np.uint8), (len(sets), 1))
            each = np.arange(len(sets))
            for i, (x, _) in enumerate(zip(swaps, moved, strict=True)):
                rows[each, i], rows[each, x] = rows[each, x], rows[each, i]
            swaps, moved = [], []
        if rows is not None:
            each = np.arange(len(sets))
            place = rows[each, k]
            rows[each, k] = rows[:, j]
        else:
            place, own = k.copy(), np.full(len(sets), j, np.uint8)
            for x, was in zip(swaps, moved, strict=True):
                hit = x == k
                place[hit] = was[hit]
                hit = x == j
                own[hit] = was[hit]
            swaps.append(k)
            moved.append(own)
        np.minimum.at(out, owner * m + place, value)
    return out.reshape(n, m)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return key


def _sums(sets: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets + np.uint64(seed)), out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices(batch, 1, CUT_AT)):
        sets, counts = shingle_sets(part.column(1).to_pylist())
        has = np.flatnonzero(counts)
        keys = band_keys(super_minhash(sets, counts[has])) if len(has) else np.zeros((0, BANDS), np.uint64)
        offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(counts.astype(np.int64)),
                pa.array(_sums(sets, counts, 0x1B873593).view(np.int64)),
                pa.array(_sums(sets, counts, 0x7FEB352D).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64))),
            ],
            names=["doc_id", "n_shingles", "k1", "k2", "bands"],
        )


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices(batch, 1, CUT_AT)):
        k1, k2 = (np.asarray(part.column(i)) for i in (2, 3))
        sets, counts = shingle_sets(part.column(1).to_pylist())
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        packed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.view(np.int64)))
        own = (_sums(sets, counts, 0x1B873593).view(np.int64) == k1) & (_sums(sets, counts, 0x7FEB352D).view(np.int64) == k2)
        made = pa.RecordBatch.from_arrays([part.column(0), part.column(2), packed], names=["rep", "k1", "shingles"])
        yield made.filter(pa.array(own))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are as similar as a link asks for."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= SHARE * (len(a) + len(b) - common)


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for i in (2, 3):
            column = batch.column(i)
            sides.append((np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)))
        (x, i), (y, j) = sides
        ok = [linked(x[i[r] : i[r + 1]], y[j[r] : j[r + 1]]) for r in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of an undirected graph reaches.

    Union-find as alternating star contractions: every node hands its larger, then its smaller
    neighbours to the smallest one, until only stars are left.  Minima are combined before they are
    shuffled, and the larger neighbours of nodes with very many of them meet their minimum by broadcast, so
    a node with any number of neighbours stays spread over tasks.
    """
    pairs = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "graph")
    before = _digest(pairs)
    while True:
        turned = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = pairs.unionByName(turned).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        many = pairs.groupBy("v").count().filter(F.col("count") > max(before[0] // HOT_KEYS, 64)).select("v")
        hubs = [r["v"] for r in many.collect()]  # HOT_KEYS ids at most
        large = turned.join(least, "u")
        if hubs:
            is_hub = F.col("u").isin(hubs)
            spread = turned.filter(is_hub).join(F.broadcast(least.filter(is_hub)), "u")
            large = spread.unionByName(turned.filter(~is_hub).join(least.filter(~is_hub), "u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        star = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        after = stored(star.select(ends.alias("x")).select("x.u", "x.v").filter("u <> v").dropDuplicates(), "graph")
        digest = _digest(after)
        drop_stored(pairs)
        pairs = after
        if digest == before:  # nothing moves any more
            out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.stored_at = pairs.stored_at
            return out
        before = digest


def _digest(pairs: DataFrame) -> tuple:
    """Count and sum of hashes of the edges."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    with small_batches(docs.sparkSession):
        return _grouped(docs, id_col, text_col)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(released(_signed), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signatures")
    keyed = signed.filter("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "k1", "k2"]
    classes = stored(
        keyed.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("rows")),
        "classes",
    )
    members = classes.select("rep", "k1", "n_shingles", F.explode("bands").alias("bucket"))
    first = F.min(F.struct("rep", "k1", "n_shingles")).alias("c")
    centres = members.groupBy("bucket").agg(first, F.count("*").alias("n")).filter("n > 1")
    shared = stored(members.join(centres.select("bucket", "c"), "bucket"), "buckets")  # buckets of two members or more
    wanted = shared.select("rep", "k1").dropDuplicates().join(classes.select("rep", "k1", "k2"), ["rep", "k1"])
    rows = texts.join(wanted, texts["doc_id"] == wanted["rep"]).select("rep", "text", "k1", "k2")
    # An id may stand on several rows; a class's own set is the one with its digest.
    sets = stored(rows.mapInArrow(released(_as_sets), "rep long, k1 long, shingles array<long>").dropDuplicates(["rep", "k1"]), "sets")

    def tested(pairs: DataFrame) -> DataFrame:
        """The links (a, b) among pairs of classes, tested on full sets; each pair is tested once."""
        fit = pairs.filter(f"{OF} * least(n_a, n_b) >= {SHARE} * greatest(n_a, n_b)").select("a", "ka", "b", "kb").dropDuplicates()
        both = fit.join(sets.toDF("a", "ka", "sa"), ["a", "ka"]).join(sets.toDF("b", "kb", "sb"), ["b", "kb"])
        return both.select("a", "b", "sa", "sb").mapInArrow(released(_tested), "a long, b long")

    # Rows of one id in several classes tie these together.
    ties = keyed.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("x <> y")
    ties = keyed.select("doc_id", *key).join(ties.select("doc_id"), "doc_id").join(classes.select("rep", *key), key)
    stars = shared.filter("rep <> c.rep or k1 <> c.k1").select(*_pair("rep", "k1", "n_shingles", "c.rep", "c.k1", "c.n_shingles"))
    links = tested(stars).unionByName(ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).dropDuplicates())
    labels = components(links)
    for further in (_drawn, _early):
        rows = _unsettled(shared, labels)
        more = stored(tested(further(rows, sets)), "links")
        drop_stored(rows)
        if more.limit(1).count():
            old = labels
            labels = components(old.toDF("a", "b").unionByName(more))
            drop_stored(old)
        drop_stored(more)
    drop_stored(shared)
    drop_stored(sets)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        *key, "rows", F.coalesce("component", "rep").alias("component_id")
    )
    out = ["doc_id", "n_shingles", "component_id"]
    alone = signed.filter("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    most = max(signed.count() // HOT_KEYS, 64)
    if classes.filter(F.col("rows") > most).limit(1).count():
        found = spread_join(keyed.select("doc_id", *key), named, key, "rows", most)
    else:
        found = keyed.select("doc_id", *key).join(named, key)
    found = found.select(*out).unionByName(alone.select(*out))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _pair(a: str, ka: str, n_a: str, b: str, kb: str, n_b: str) -> list[Column]:
    """Columns a, ka, n_a, b, kb, n_b of a pair of classes, the larger one first."""
    x, y = F.struct(F.col(a).alias("r"), F.col(ka).alias("k"), F.col(n_a).alias("n")), F.struct(F.col(b).alias("r"), F.col(kb).alias("k"), F.col(n_b).alias("n"))
    high, low = F.greatest(x, y), F.least(x, y)
    return [
        high["r"].alias("a"), high["k"].alias("ka"), high["n"].alias("n_a"), low["r"].alias("b"), low["k"].alias("kb"), low["n"].alias("n_b")
    ]


def _unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with components, of buckets where these are several; with the bucket's largest component."""
    named = shared.join(labels, shared["rep"] == labels["node"], "left").select(
        "bucket", "rep", "k1", "n_shingles", F.coalesce("component", "rep").alias("component")
    )
    per = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    several = per.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("largest"), F.count("*").alias("kinds"))
    several = several.filter("kinds > 1").select("bucket", F.col("largest.component").alias("most"))
    return stored(named.join(several, "bucket"), "unsettled")


def _drawn(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Members outside a bucket's largest component, each with one member of it, drawn anew in every bucket."""
    drawn = F.min_by(F.struct("rep", "k1", "n_shingles"), F.xxhash64("rep", "bucket")).alias("d")
    chosen = rows.filter("component = most").groupBy("bucket").agg(drawn)
    return rows.filter("component <> most").join(chosen, "bucket").select(*_pair("rep", "k1", "n_shingles", "d.rep", "d.k1", "d.n_shingles"))


def _early(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different components that could be similar enough, by the shingles they share early.

    The shingles of each set are ranked, rarest first.  If the first common shingle of two sets of n and m
    stands at ranks i and j, they share min(n - i, m - j) + 1 at most, and a link asks for (n + m) * 4 / 9.
    So a shingle at rank i matters only for partners of up to (n - i + 1) * 9 / 4 - n shingles, and the join
    goes by shingle and range of sizes.  One side holds only sets outside a shingle's commonest component:
    members of one component, however many they are, do not meet.
    """
    nodes = rows.select("rep", "k1", "component").dropDuplicates()
    grams = sets.join(nodes, ["rep", "k1"]).select("rep", "k1", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    common = grams.groupBy("g").agg(F.count("*").alias("held")).filter("held > 1")
    # A shingle of one set only ranks first and meets no other.
    known = grams.join(common, "g", "left").withColumn("held", F.coalesce("held", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("rep", "k1").orderBy("held", "g"))  # a set of one text
    both = SHARE + OF
    ranked = stored(
        known.withColumn("at", rank).filter("held > 1").drop("held").filter(f"{OF} * (n - at + 1) >= {SHARE} * n").withColumn("band", _band(F.col("n"))),
        "early",
    )
    per = ranked.groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g")
    most = per.agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1")
    lone = ranked.drop("band").join(most.select("g", "most"), "g").filter("component <> most")
    least, largest = F.expr(f"({SHARE} * n + {OF - 1}) div {OF}"), F.expr(f"least(({OF} * n) div {SHARE}, ({both} * (n - at + 1)) div {SHARE} - n)")
    lone = lone.withColumn("least", least).withColumn("largest", largest).filter("least <= largest")
    x = lone.select(*[F.col(c).alias(f"x_{c}") for c in ("g", "rep", "k1", "component", "n", "at", "most")], F.explode(F.sequence(_band(F.col("least")), _band(F.col("largest")))).alias("x_band"))
    meets = (
        (F.col("g") == F.col("x_g"))
        & (F.col("band") == F.col("x_band"))
        & (F.col("component") != F.col("x_component"))
        & ((F.col("component") == F.col("x_most")) | (F.struct("x_rep", "x_k1") < F.struct("rep", "k1")))
        & (both * (F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at")) + 1) >= SHARE * (F.col("n") + F.col("x_n")))
    )
    return ranked.join(x, meets).select(*_pair("rep", "k1", "n", "x_rep", "x_k1", "x_n"))


def _band(n: Column) -> Column:
    """Number of the range of sizes that ``n`` lies in: sixteen a doubling."""
    return F.floor(16 * F.log2(n.cast("double"))).cast("int")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: of the smallest id, and of that one row.

    Rows with a null id are kept; of rows that share an id the one whose text has the least hash stays.
    """
    found = group(docs, id_col, text_col).filter("doc_id is not null")
    state = found.groupBy("doc_id").agg(F.min("kept").alias("__kept"), F.count("*").alias("__rows"))
    state = state.withColumnRenamed("doc_id", "__id").filter("not __kept or __rows > 1")
    state = stored(state, "not-single")
    own = F.col(id_col).cast("bigint")
    single = docs.join(state, own == F.col("__id"), "left_anti")
    several = state.filter("__kept").select(F.col("__id").alias("__several"))
    if several.limit(1).count() == 0:
        return single.select(*docs.columns)
    again = docs.select(own.alias("__id"), F.struct(*docs.columns).alias("__row")).join(several, F.col("__id") == F.col("__several"))
    text = F.coalesce(F.col("__row")[text_col], F.lit(""))
    picked = again.groupBy("__id").agg(F.min_by("__row", F.struct(F.xxhash64(text), text)).alias("r")).select("r.*")
    return single.select(*docs.columns).unionByName(picked)


def sql() -> str:
    """The result of ``group`` in DuckDB SQL: an exact self-join on shingles, and reachability by recursion."""
    return rf"""
WITH RECURSIVE word AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM word),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE {OF} * c >= {SHARE} * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reach JOIN both_ways ON x = reach.doc_id),
least AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)"""
