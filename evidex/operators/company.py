"""Companies in questions and documents: clues, markers, resolution, periods."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import substrings
from .metrics import METRICS

# Kinds of clues by strength, endings of full names, words that begin a question.
KINDS = ("code", "name", "st", "alias")
FULL = re.compile("[一-鿿A-Za-z0-9（）()·]{2,30}?(?:股份有限公司|有限责任公司|集团有限公司|有限公司)")
ST = re.compile(r"\*?ST\s*[一-鿿A-Za-z]{2,6}", re.IGNORECASE)
CODE = re.compile(r"(?<!\d)(?:00|30|60|68|43|83|87|92)\d{4}(?!\d)")
ASKED = re.compile("^(?:请问|请|帮我|查询|查一下|根据|关于|分析|对比)+")
METRIC = re.compile("营业总?收入|净利润|现金流量|研发|资产总额|负债总额|每股收益|毛利率")
SUFFIX = re.compile("(?:股份有限公司|有限责任公司|集团有限公司|有限公司|集团|股份|公司)$")


def plain(name: str) -> str:
    return re.sub(r"[\s*]+", "", unicodedata.normalize("NFKC", name)).casefold()


def base(name: str) -> str:
    """A name without its legal form."""
    out = plain(name)
    while (cut := SUFFIX.sub("", out)) != out and len(cut) >= 2:
        out = cut
    return out


def clues_of(question: str) -> list[tuple[str, str]]:
    """What a question says of its company: code, full name, ST name, or the words before a year or metric."""
    text, out = question or "", []

    def add(kind, value):
        if len(value) >= 2 and (kind, value) not in out:
            out.append((kind, value))

    for m in FULL.finditer(text):
        name = ASKED.sub("", m[0])
        add("name", plain(name))
        add("alias", base(name))
    for m in ST.finditer(text):
        add("st", plain(m[0]))
        add("alias", plain(m[0]).removeprefix("st"))
    for m in CODE.finditer(text):
        add("code", m[0])
    head = ASKED.sub("", text.strip())
    cut = re.search(r"(?:19|20)\d\d\s*年", head) or METRIC.search(head)
    head = head[: cut.start()].strip(" 的，,：:？?\t\r\n") if cut else ""
    if re.fullmatch(r"[一-鿿A-Za-z0-9（）()·&.\-*]{2,40}", head):
        add("alias", base(head))
    return out


CLUES = "array<struct<kind: string, value: string>>"


def _clues(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "value": v} for k, v in clues_of(t)] for t in texts], dtype=object)


def clues(question: Column) -> Column:
    return F.pandas_udf(_clues, CLUES)(question)


def _markers(titles: pd.Series, names: pd.Series, codes: pd.Series) -> pd.Series:
    out = []
    for title, name, code in zip(titles, names, codes):
        found = set()
        for text in (title or "", name or ""):
            for m in FULL.finditer(text):
                found |= {("name", plain(m[0])), ("alias", base(m[0]))}
            found |= {("st", plain(m[0])) for m in ST.finditer(text)}
        if name:
            found.add(("alias", base(name)))
        elif title and (head := re.split(r"(?:19|20)\d\d", title)[0].strip()):
            found.add(("alias", base(head)))
        found |= {("code", c) for c in CODE.findall(f"{code or ''} {title or ''}")}
        out.append([{"kind": k, "value": v} for k, v in sorted(found) if len(v) >= 2])
    return pd.Series(out, dtype=object)


def markers(title: Column, name: Column, code: Column) -> Column:
    """What a document's fields say of its company."""
    return F.pandas_udf(_markers, CLUES)(title, name, code)


def strength(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, i).otherwise(out)
    return out


def resolved(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, company, candidates): the company of that name, else the only one that holds the name or is held by it.

    ``known`` (company) is the list of companies, ``asked`` (asked) a request's names. Each side's names are looked for
    in the other's, in one scan of either; an empty name holds and is held by none.
    """
    names = known.select("company").distinct()
    a, k = F.lower("asked"), F.lower("company")
    held = substrings.occurrences(names.select("company", k.alias("text")), asked.select("asked", a.alias("needle")).distinct())
    holds = substrings.occurrences(asked.select("asked", a.alias("text")).distinct(), names.select("company", k.alias("needle")))
    pairs = held.select("asked", "company").unionByName(holds.select("asked", "company"))
    found = pairs.groupBy("asked").agg(F.array_sort(F.collect_set("company")).alias("candidates"), F.max(F.when(F.col("asked") == F.col("company"), F.col("company"))).alias("same"))
    one = F.when(F.size("candidates") == 1, F.element_at("candidates", 1)).otherwise("")
    both = asked.select("asked").distinct().join(found, "asked", "left")
    return both.select("asked", F.coalesce("same", F.when(F.col("candidates").isNotNull(), one), F.lit("")).alias("company"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def period_candidates(text: str) -> list[str]:
    """Equivalent spellings of an annual period in order of priority; any other is itself."""
    bare = re.sub(r"\s+", "", unicodedata.normalize("NFKC", text or ""))
    return [f"{bare[:4]}年度", f"{bare[:4]}年", bare[:4]] if re.fullmatch(r"(?:19|20)\d\d(?:年(?:度|报)?)?", bare) else [bare]


def first_period(records: DataFrame, asked: str) -> DataFrame:
    """The records of the first spelling of a period that each entity has any for."""
    order = F.array_position(F.array(*[F.lit(p) for p in period_candidates(asked)]), F.col("report_period"))
    some = records.withColumn("_at", order).filter("_at > 0")
    best = some.groupBy("entity").agg(F.min("_at").alias("_at"))
    return some.join(best, ["entity", "_at"], "left_semi").drop("_at")


def selection(names: list[str] | None, codes: list[str] | None = None) -> tuple[list[str], list[str]]:
    """A request's two or three different companies, and its metrics in their order; ValueError otherwise."""
    names = [str(n).strip() for n in names or []]
    if not 2 <= len(names) <= 3 or not all(names) or len(set(names)) != len(names):
        raise ValueError("two or three different companies are needed")
    codes = [str(c).strip() for c in codes or METRICS]
    if unknown := [c for c in codes if c not in METRICS]:
        raise ValueError(f"no such metrics: {', '.join(unknown)}")
    return names, [m for m in METRICS if m in codes]


def question_periods(text: Column) -> Column:
    """The distinct periods that a question names, in order, in one spelling."""
    found = F.regexp_extract_all(F.regexp_replace(text, "\\s", ""), F.lit("((?:19|20)[0-9]{2}年?(?:半年度|上半年|下半年|第?[一二三四]季度|年度|年报)?)"), 1)
    from ..functions.text import normal_period

    return F.array_distinct(F.transform(F.filter(found, lambda p: F.length(p) > 4), lambda p: normal_period(p)))
