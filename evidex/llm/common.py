"""Shared plumbing: Arrow row maps with bounded memory, tables of a process, tables kept in the shared folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..tables import finished, keep, release, shared_dir, spread  # noqa: F401  for the operators here

#: Rows handled at a time inside a task: only so many texts are Python objects at once.
SLICE = 128


def arrow_map(df: DataFrame, columns: list, start: Callable, schema: str | T.StructType, rows: int = SLICE) -> DataFrame:
    """Map ``columns`` of ``df`` through Python, a slice of ``rows`` at a time.

    ``start()`` runs once a task and returns ``step(*lists)``, which takes one list for each
    column and returns one list or Arrow array for each field of ``schema``. Rows may become
    more or fewer. An empty input gives an empty output.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = step(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*columns).mapInArrow(run, fields)


def arrow_filter(df: DataFrame, column: str, start: Callable) -> DataFrame:
    """The rows of ``df`` for which ``start()``'s function of a list of ``column`` gives true; other columns stay as they are, of any type."""
    at, schema = df.columns.index(column), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = start()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                yield part.filter(pa.array(wanted(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, schema)


def arrow_replace(df: DataFrame, column: str, start: Callable) -> DataFrame:
    """``df`` with ``column`` (a string) replaced by what ``start()``'s function makes of lists of it; other columns stay as they are."""
    at, schema = df.columns.index(column), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = start()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                yield part.set_column(at, part.schema.field(at), pa.array(change(part.column(at).to_pylist()), part.schema.field(at).type))

    return df.mapInArrow(run, schema)


def per_process(key: tuple, make: Callable):
    """What ``make()`` gave the first time in this Python process: tables outlive tasks, whose workers Spark reuses.

    They hang on the interpreter, not on this module: where code is shipped by value, each task has globals of its own.
    """
    held = sys.modules.setdefault("_evidex_held", types.ModuleType("_evidex_held")).__dict__
    name = repr(key)
    if name not in held:
        held[name] = make()
    return held[name]


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
