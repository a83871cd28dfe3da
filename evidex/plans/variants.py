"""Queries of rules on texts: each customer gets a text of its own, made of one of some forms and of the customer's values.

A form has places for a year, the year before, a number and a name, which come from the customer's balance and market
segment. The forms are the query's, what is expected of them the SQL's, which fills in the values by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import ORACLES, QUERIES, table


#: Places in a form, and what fills them: in Spark of ``c_acctbal`` and ``c_mktsegment``, in SQL likewise.
FILLED = {
    "⟨y⟩": ("cast(2001 + cast(abs(c_acctbal) as bigint) % 24 as string)", "CAST(2001 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 24 AS VARCHAR)"),
    "⟨p⟩": ("cast(2000 + cast(abs(c_acctbal) as bigint) % 24 as string)", "CAST(2000 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 24 AS VARCHAR)"),
    "⟨n⟩": ("cast(100 + cast(abs(c_acctbal) as bigint) % 900 as string)", "CAST(100 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 900 AS VARCHAR)"),
    "⟨w⟩": ("c_mktsegment", "c_mktsegment"),
    "⟨v⟩": ("lower(c_mktsegment)", "lower(c_mktsegment)"),
}


def _places(value) -> bool:
    return any(map(_places, value)) if isinstance(value, (list, tuple)) else isinstance(value, str) and "⟨" in value


def _literal(value, kind: str | None) -> Column:
    if isinstance(value, (list, tuple)):
        out = F.array(*[_literal(v, None) for v in value])
        return out.cast(kind) if kind else out
    out = F.lit(value)
    if _places(value):
        for place in FILLED:
            out = F.replace(out, F.lit(place), F.col(place)) if place in value else out
    return out.cast(kind) if kind else out


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        out = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in value.split("\n"))
        for place, (_, sql) in FILLED.items():
            out = f"replace({out}, '{place}', {sql})" if place in value else out
        return out
    return f"CAST('{value}' AS DECIMAL(30,6))" if isinstance(value, Decimal) else f"CAST({value} AS DOUBLE)" if isinstance(value, float) else str(value)


def chosen(values: Sequence, kind: str | None = None, key: str = "k") -> Column:
    """The value for a row's key."""
    return F.element_at(F.array(*[_literal(v, kind) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def keyed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *[F.expr(e).alias(place) for place, (e, _) in FILLED.items()])


def rule(name: str, inputs: dict[str, Sequence], expected: dict[str, Sequence], make: Callable[[DataFrame], DataFrame], kinds: dict[str, str] | None = None) -> None:
    """Register ``make`` of (k, inputs) as a query, and SQL for (k, expected)."""
    n = len(next(iter(inputs.values())))
    assert all(len(v) == n for v in (*inputs.values(), *expected.values())), name

    def run(spark, sf_dir):
        rows = keyed(spark, sf_dir).select("k", *[chosen(v, (kinds or {}).get(c)).alias(c) for c, v in inputs.items()])
        return make(rows).select("k", *expected)

    run.__name__ = run.__qualname__ = name
    cases = [f"CASE c_custkey % {n} " + " ".join(f"WHEN {i} THEN {_sql(x)}" for i, x in enumerate(v)) + f" END AS {c}" for c, v in expected.items()]
    QUERIES[name] = run
    ORACLES[name] = f"SELECT c_custkey k, {', '.join(cases)} FROM customer"
