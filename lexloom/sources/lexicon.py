"""The lexicon's relations: loading, validation, derived indexes, and readers of nested JSON texts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "form_index": "kind string, form string, model string, stem string, ord int",
    "paradigm": "kind string, model string, stem string, refs string, cells array<string>",
    "dict_entry": "dict_name string, headword string, components string, body string, body_pos int",
    "type_map": "abbr string, description string",
    "stopword": "word string",
}


class LexiconNotFoundError(FileNotFoundError):
    """A table of the lexicon is missing, or lacks a column."""


@dataclass
class Lexicon:
    form_index: DataFrame
    paradigm: DataFrame
    dict_entry: DataFrame
    type_map: DataFrame
    stopword: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lexicon:
        """One Parquet table a relation below ``path``."""
        tables = {}
        for name, schema in SCHEMAS.items():
            try:
                df = spark.read.parquet(f"{path}/{name}")
            except Exception as e:
                raise LexiconNotFoundError(f"{path}/{name}") from e
            missing = {c.split()[0] for c in schema.split(", ")} - set(df.columns)
            if missing:
                raise LexiconNotFoundError(f"{path}/{name} lacks {sorted(missing)}")
            tables[name] = df
        return cls(**tables)

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows: list[tuple]) -> Lexicon:
        return cls(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()})

    def save(self, path: str) -> None:
        """Dictionaries lie in a folder each, so that a search of some reads only those."""
        for name in SCHEMAS:
            writer = getattr(self, name).write.mode("overwrite")
            (writer.partitionBy("dict_name") if name == "dict_entry" else writer).parquet(f"{path}/{name}")


def read_type_map(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated: abbreviation, description, more columns that are dropped."""
    return spark.read.csv(path, sep="\t", schema="abbr string, description string, ref string").select("abbr", "description")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    words = spark.read.csv(path, header=True, schema="word string").select(F.trim("word").alias("word"))
    return words.filter("word is not null and word <> ''").distinct()


def headword_index(entries: DataFrame) -> DataFrame:
    """headword, dicts: the dictionaries that have each headword, sorted."""
    return entries.groupBy("headword").agg(F.array_sort(F.collect_set("dict_name")).alias("dicts"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """key: the strings of a JSON list, each once."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("key")).distinct()


def from_sqlite(spark: SparkSession, database: str, path: str, tables: dict[str, str], rows: int = 100_000) -> None:
    """One-off conversion of a lexicon in a SQLite file: each relation's SELECT is read in parts of ``rows`` and saved for ``Lexicon.load``."""
    import sqlite3
    from contextlib import closing

    with closing(sqlite3.connect(f"file:{database}?mode=ro", uri=True)) as connection:
        for name, select in tables.items():
            cursor, mode = connection.execute(select), "overwrite"
            while (part := cursor.fetchmany(rows)) or mode == "overwrite":
                listed = [[json.loads(v) if isinstance(v, str) and t == "array<string>" else v for v, t in zip(r, _types(name), strict=True)] for r in part]
                writer = spark.createDataFrame(listed, SCHEMAS[name]).write.mode(mode)
                (writer.partitionBy("dict_name") if name == "dict_entry" else writer).parquet(f"{path}/{name}")
                mode = "append"


def _types(name: str) -> list[str]:
    return [c.split()[1] for c in SCHEMAS[name].split(", ")]


def compounds(df: DataFrame, column: str) -> DataFrame:
    """All columns but ``column``, with category, idx, text, source_file of {compounds: {category: [{text, source_file}]}}."""
    rest = [c for c in df.columns if c != column]
    schema = "compounds map<string, array<struct<text: string, source_file: string>>>"
    rows = df.select(*rest, F.explode(F.from_json(column, schema)["compounds"]).alias("category", "items"))
    return rows.select(*rest, "category", F.posexplode("items").alias("idx", "item")).select(*rest, "category", "idx", "item.*")


def read_compounds(spark: SparkSession, path: str) -> DataFrame:
    """category, idx, text, source_file of a JSON document {compounds: {category: [{text, source_file}]}}."""
    return compounds(spark.read.text(path, wholetext=True), "value")


def write_report(lines: DataFrame, path: str) -> None:
    """The column ``line`` as text files, in the order of ``pos``."""
    lines.orderBy("pos").select("line").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def texts_in_json(df: DataFrame, column: str, key: str = "text") -> DataFrame:
    """All columns but ``column``, with pos and text of each string under ``key``, at any depth, in pre-order."""
    rest = [f for f in df.schema.fields if f.name != column]

    def found(node) -> Iterator[str]:
        stack = [node]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                for k, v in reversed(x.items()):
                    stack.append((v,) if k == key and isinstance(v, str) else v)
            elif isinstance(x, list):
                stack += x[::-1]
            elif isinstance(x, tuple):
                yield x[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, out = [], [], []
            for i, body in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    texts = list(found(json.loads(body))) if body else []
                except ValueError:
                    texts = []
                at += [i] * len(texts)
                pos += range(len(texts))
                out += texts
            kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(pos, pa.int32()), pa.array(out, pa.string())], names=[*[f.name for f in rest], "pos", "text"]
            )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "pos int", "text string"])
    return df.select(*[f.name for f in rest], column).mapInArrow(run, schema)
