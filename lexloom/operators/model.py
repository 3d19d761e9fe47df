"""Segmentation by an external sequence model: prompts, batches, clean-up, fallback.

The model itself is injected: ``backend`` makes, once in a worker, a function from a list of prompts to
a list of outputs.  A text that is too long for one prompt becomes several, whose outputs are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, text

BATCH, MAX_LENGTH = 20, 512
Backend = Callable[[], Callable[[list[str]], list[str]]]


def pieces(whole: str, most: int) -> list[tuple[str, str]]:
    """(piece, what joins it to the next) of a text: ``most`` characters at most, cut at white space where there is any."""
    out, at = [], 0
    while len(whole) - at > most:
        end = next((i for i in range(at + most, at, -1) if whole[i].isspace()), None)
        out.append((whole[at : end or at + most], " " if end else ""))
        at = end + 1 if end else at + most
    return [*out, (whole[at:], "")]


def run_model(df: DataFrame, column: str, backend: Backend, task: str = "segmentation", batch: int = BATCH) -> DataFrame:
    """``df`` with ``output``: the cleaned model output, or the input where that is blank (piece by piece)."""
    rest = df.columns
    names = ("raw", "piece", "after")
    made_of = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    schema = T.StructType([*df.schema.fields, T.StructField("__raw", made_of)])
    kind = pa.list_(pa.struct([(n, pa.string()) for n in names]))
    head = rules.MODEL_TASKS.get(task, "S ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend()
        for b in batches:
            cut = [None if t is None else pieces(t, MAX_LENGTH - len(head)) for t in b.column(rest.index(column)).to_pylist()]
            prompts = [head + p for parts in cut if parts for p, _ in parts]
            made = iter([x for i in range(0, len(prompts), batch) for x in model(prompts[i : i + batch])])
            out = [parts and [{"raw": next(made), "piece": p, "after": after} for p, after in parts] for parts in cut]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*rest, "__raw"])

    def clean(x: Column) -> Column:
        return F.concat(text.or_original(text.strip_tags(x["raw"]), x["piece"]), x["after"])

    got = df.mapInArrow(run, schema)
    return got.withColumn("output", F.array_join(F.transform("__raw", clean), "")).drop("__raw")


def segmented(docs: DataFrame, backend: Backend, task: str = "segmentation") -> DataFrame:
    """doc_id, pos, surface: the model's segments as the tokens that annotation starts from."""
    out = run_model(docs.select("doc_id", "text"), "text", backend, task)
    return out.select("doc_id", F.posexplode(text.tokens(F.col("output"))).alias("pos", "surface"))
