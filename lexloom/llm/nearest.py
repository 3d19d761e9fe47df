"""Approximate nearest neighbours by collision-counting hashing.

Each projection alone orders the vectors of a block.  Around a query's own projection stands a window
that grows from round to round (virtual rehashing: wider buckets without hashing anew); every vector
counts the projections whose window holds it, and one that reaches the threshold is verified by its
exact distance.  A query stops when its k-th verified vector is so near that a nearer one would have
reached the threshold (within SURE standard deviations of its count), or when its windows hold
everything.  So data with clear neighbours stop early, and nothing else caps the candidates.

Queries and rows are dealt into blocks of bounded size; each pair of blocks is searched by itself and
leaves at most k rows a query, of which the best k are kept.  Vectors are sent once a query block and
queries once a row block, so blocks of queries are large; the queries being a fixed share of the rows, the
pairs of blocks still grow with the square of the rows.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part;
vectors of another length than the query's are no candidates of it; equal rows (id and vector) count
once; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD = 96, 0.5
#: Growth of the radius a round, and how many standard deviations beyond its mean a count may miss.
GROWTH, SURE = 1.2, 1.3
#: A vector at distance s collides in half of its projections, in the mean, once the radius is HALF * s.
HALF = 0.6745
#: Places in a block's orders are kept in 16 bits, so blocks stay well under 65,536 rows.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Queries that try out from which radius the others start.
SCOUTS = 8


def usable(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    return df.filter(
        v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )


def search_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, id, distance) arrays: up to ``k`` nearest of the block's rows for each query found so."""
    n, d = rows.shape
    axes = np.random.default_rng(d).normal(size=(d, PROJECTIONS))
    projected = np.ascontiguousarray((rows @ axes).T)
    order = np.argsort(projected, 1, kind="stable")
    ordered = np.take_along_axis(projected, order, 1)
    place = np.empty((PROJECTIONS, n), np.uint16 if n < 1 << 16 else np.uint64)
    np.put_along_axis(place, order, np.arange(n, dtype=place.dtype)[None], 1)
    centre = (queries @ axes).T
    squares = (rows * rows).sum(1)
    need = int(np.ceil(THRESHOLD * PROJECTIONS))
    slack = 1 + SURE * np.sqrt(0.25 / PROJECTIONS) / 0.4286  # 0.4286: slope of the count's mean in log radius
    # The first window holds about a quarter of the rows where a projection is densest.
    spread = max(np.quantile(np.abs(projected - np.median(projected, 1)[:, None]), 0.25), 1e-12)
    best: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], np.zeros(0))] * len(queries)

    def widen(active: np.ndarray, radius: np.ndarray) -> list[float]:
        """The radii at which the queries stop; their windows grow together."""
        final = []
        while len(active):
            low, high = (
                np.stack([np.searchsorted(ordered[j], centre[j, active] + side * radius, which) for j in range(PROJECTIONS)]).astype(place.dtype)
                for side, which in ((-1, "left"), (1, "right"))
            )
            wide = high - low
            going = np.zeros(len(active), bool)
            for i, q in enumerate(active):
                # Places below the window wrap round to large numbers, as these have no sign.
                inside = place - low[:, i, None] < wide[:, i, None]
                hits = np.flatnonzero(np.add.reduce(inside.view(np.uint8), 0, dtype=np.uint8) >= need)
                hits = hits[ids[hits] != query_ids[q]]
                if len(hits) > k:  # products leave those that rounding could put among the k nearest
                    rough = squares[hits] - 2 * (rows[hits] @ queries[q])
                    most = np.partition(rough, k - 1)[k - 1]
                    hits = hits[rough <= most + 1e-9 * (1 + abs(most) + squares[hits])]
                gap = rows[hits] - queries[q]
                distance = np.sqrt((gap * gap).sum(1))
                whole = not low[:, i].any() and (high[:, i] == n).all()
                near = len(hits) >= k and np.partition(distance, k - 1)[k - 1] * HALF * slack <= radius[i]
                going[i] = not (whole or near)
                if not going[i]:
                    final.append(radius[i])
                    first = np.lexsort((ids[hits], distance))[:k]
                    best[q] = ids[hits[first]], distance[first]
            active, radius = active[going], radius[going] * GROWTH
        return final

    started = np.arange(min(SCOUTS, len(queries)))
    found = widen(started, np.full(len(started), spread))
    started = np.arange(len(started), len(queries))
    if len(started):
        widen(started, np.full(len(started), max(np.median(found) / GROWTH, spread)))
    return (
        np.repeat(query_ids, [len(i) for i, _ in best]),
        np.concatenate([i for i, _ in best]),
        np.concatenate([x for _, x in best]),
    )


def search(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for the rows whose id ``every`` divides."""
    rows = (
        usable(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")), "v")
        .filter(F.col("id").isNotNull())
        .dropDuplicates(["id", "v"])
        .withColumn("dim", F.size("v"))
    )
    n = rows.count()
    blocks, query_blocks = n // BLOCK_ROWS + 1, n // every // BLOCK_QUERIES + 1
    # A hash deals both out evenly, so blocks keep near their sizes.
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    asked = (
        rows.filter(F.col("id") % every == 0)
        .withColumn("query_block", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(query_blocks)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    )
    keys = ["block", "query_block", "dim"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)

        def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            v = t.column("v").combine_chunks()
            return np.asarray(t.column("id")), np.asarray(v.flatten()).reshape(t.num_rows, -1)

        q, i, d = search_block(*arrays(left), *arrays(right), k)
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=names)

    found = (
        placed.select("id", "v", *keys)
        .groupBy(*keys)
        .cogroup(asked.select("id", "v", *keys).groupBy(*keys))
        .applyInArrow(run, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
