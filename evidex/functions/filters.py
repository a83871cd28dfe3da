"""Metadata filters: a nested dictionary of conditions becomes one Column.

Equality takes a missing field for null; $ne and $nin keep rows where it is missing; ordered comparisons
with a missing field, comparisons of unlike kinds and unknown operators are false. Everything is resolved
when the plan is made, so the conditions reach the scan as ordinary predicates. In a filter a null counts as
false, so only a negation has to say so.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERED = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}
#: Fields that a request from outside may filter by, and the size of its filter in bytes.
ALLOWED = ("doc_id", "doc_title", "source_type", "page", "section_path", "table_name", "statement_scope", "report_period", "unit", "is_table")
LARGEST = 4096
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _like(kind: str | None, value) -> bool:
    """Whether values of a column's type and a literal can be put in order."""
    if kind is None:
        return True
    if isinstance(value, bool):
        return kind == "boolean"
    if isinstance(value, (int, float)):
        return kind.startswith(NUMBERS)
    return isinstance(value, str) == (kind == "string")


def _same(actual: Column, kind: str | None, value) -> Column:
    if value is None:
        return actual.isNull()
    return actual.eqNullSafe(F.lit(value)) if _like(kind, value) else F.lit(False)


def compiled(where: dict | None, column: Callable[[str], tuple[Column, str | None]]) -> Column:
    """``column(field)``: a field's Column and type name; a missing field is a null."""
    out = F.lit(True)
    for name, condition in (where or {}).items():
        if name == "$and":
            for item in condition:
                out = out & compiled(item, column)
        elif name == "$or":
            some = F.lit(False)
            for item in condition:
                some = some | compiled(item, column)
            out = out & some
        elif name == "$not":
            out = out & ~F.coalesce(compiled(condition, column), F.lit(False))
        else:
            actual, kind = column(name)
            for operator, value in (condition if isinstance(condition, dict) else {"$eq": condition}).items():
                out = out & _one(actual, kind, operator, value)
    return out


def _one(actual: Column, kind: str | None, operator: str, value) -> Column:
    if operator in ("$eq", "$ne"):
        same = _same(actual, kind, value)
        return same if operator == "$eq" else ~same
    if operator in ("$in", "$nin"):
        some = F.lit(False)
        if typed := [v for v in value if v is not None and _like(kind, v)]:
            some = actual.isin(typed)
        if None in value:
            some = some | actual.isNull()
        return some if operator == "$in" else ~F.coalesce(some, F.lit(False))
    if operator in ORDERED and value is not None and _like(kind, value):
        return ORDERED[operator](actual, F.lit(value))
    return F.lit(False)


def where(df: DataFrame, condition: dict | None, kb_id: str | None = None, kb_col: str = "kb_id") -> DataFrame:
    """The rows that match; with ``kb_id``, only of that knowledge base, where none means the default one."""
    kinds = dict(df.dtypes)
    out = df.filter(compiled(condition, lambda f: (F.col(f), kinds[f]) if f in kinds else (F.lit(None), None)))
    if kb_id is not None:
        out = out.filter(F.coalesce(F.col(kb_col).cast("string"), F.lit("default")) == kb_id)
    return out


def checked(condition: dict | None, allowed=ALLOWED) -> dict:
    """A filter from outside, or ValueError: only allowed fields, not too large."""
    condition = condition or {}
    if len(json.dumps(condition, ensure_ascii=False).encode()) > LARGEST:
        raise ValueError("the filter is too large")

    def walk(node: dict) -> None:
        for name, value in node.items():
            if name in ("$and", "$or"):
                for item in value:
                    walk(item)
            elif name == "$not":
                walk(value)
            elif name not in allowed:
                raise ValueError(f"no filter by {name}")

    walk(condition)
    return condition


def flag(value: Column) -> Column:
    """A tolerant boolean: true, 1 and yes in any case."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))
