"""What the training-data operators share: reading, durable intermediate tables, array helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import drop_stored, shared_dir, stored

__all__ = ["added", "bound", "chunks", "drop_stored", "matches", "no_matches", "released", "running", "shared_dir", "small_batches", "spans_text", "spread_join", "stored", "table", "with_row", "words_of"]

#: White space of the word rule, as a regular expression and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Matches folded into one accumulator before the outer fold sees them; keeps folds near linear.
CHUNK = 256
#: Rows of an Arrow batch whose rows hold whole texts or sets; the executor and its worker each hold a batch of every task.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow functions that run get at most BATCH_ROWS rows at a time; the session's own setting comes back behind."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    if not 0 < int(own) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """An Arrow function whose worker hands the memory it no longer needs back to the machine at a task's end.

    Workers wait for later tasks of any operator, and what they hold meanwhile is taken from these.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], held: str, most: int) -> DataFrame:
    """``rows`` joined with ``table``, whose column ``held`` says how many rows each key has.

    Keys with more than ``most`` rows are broadcast, so their rows stay where they are; these keys are
    fewer than the rows divided by ``most``.  All others are joined as usual.
    """
    hot = F.broadcast(table.filter(F.col(held) > most))
    cold = rows.join(hot.select(*on), on, "left_anti").join(table.filter(F.col(held) <= most), on)
    return rows.join(hot, on).unionByName(cold)


def words_of(col: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def with_row(docs: DataFrame, text_col: str) -> DataFrame:
    """``__row``, all columns as they are, and ``__text`` (null: empty): so no column's name can clash with an operator's own."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("__row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))


def added(df: DataFrame, docs: DataFrame, **columns: Column) -> DataFrame:
    """The columns of ``docs`` out of ``__row``, and ``columns``; an input column of such a name is replaced."""
    own = [F.col("__row")[c].alias(c) for c in docs.columns if c not in columns]
    return df.select(*own, *[c.alias(name) for name, c in columns.items()])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used; else each use within a lambda evaluates it anew."""
    return F.get(F.transform(F.array(value), use), 0)


def chunks(values: Column) -> Column:
    """An array (evaluated for every slice: a column or a bound value) in slices of CHUNK; none of an empty one."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i, CHUNK))


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b, zero: int = 0) -> Column:
    """Running totals (or maxima, ...) of an array<long>, itself included, in two levels of folds."""
    empty, start = F.array().cast("array<bigint>"), F.lit(zero).cast("bigint")

    def fold(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(start.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(join(acc["at"], x))).alias("out")),
        )

    both = F.aggregate(
        bound(values, lambda v: F.transform(chunks(v), fold)),
        F.struct(start.alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda acc, p: F.struct(
            join(acc["at"], p["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.transform(p["out"], lambda x: join(acc["at"], x)))).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return both


def matches(text: Column, pattern: str, kind: str, group: int | None = None) -> Column:
    """All leftmost non-overlapping matches as array<struct<s,e,kind,g>>; s and e count code points.

    The text between matches and the matches themselves are measured in turn, so places need no
    user-defined function.  ``g`` is the length of capture group ``group`` (or of the match).
    """
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hit
    gap = F.split(text, pattern, -1)  # one more than the matches

    def placed(m: Column) -> Column:
        return F.zip_with(
            running(F.zip_with(F.slice(gap, 1, F.size(m)), m, lambda a, x: F.length(a).cast("bigint") + x["n"])),
            m,
            lambda end, x: F.struct((end - x["n"]).alias("s"), end.alias("e"), F.lit(kind).alias("kind"), x["g"].alias("g")),
        )

    return bound(F.zip_with(hit, part, lambda h, p: F.struct(F.length(h).alias("n"), F.length(p).alias("g"))), placed)


NO_MATCHES = "array<struct<s:bigint,e:bigint,kind:string,g:int>>"


def no_matches() -> Column:
    return F.array().cast(NO_MATCHES)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the array's order."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )
