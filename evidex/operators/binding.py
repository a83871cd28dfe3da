"""Which metric, period, scope and adjustment a number of a text belongs to.

A text is read once: its metric names, its numbers, its lines. A number's own line tells its metric first,
then the lines above it, then the row that it stands in; a row's place in the order of the header's columns
tells its period, and whether it is a share of change. What cannot be told stays empty; a caller's question
and the fields of the passage fill it in where they leave no choice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .verify import _nearest, claims_of, mentions, normalised

# How far a number's label may be, in lines and characters, and how far words that date it or give its scope.
ABOVE_LINES, ABOVE, ROW, DATED, CONTEXT = 4, 200, 180, 20, 120
# Words of change columns, of tables, of key tables, and of adjusted columns.
CHANGE = re.compile("同比|增减|增幅|增长率|下降率|百分比|百分点|[(]%|％")
TABLE = re.compile("主要会计数据|主要财务指标|本报告期.*上年同期|单位[:：]")
KEY_TABLES = ("主要会计数据", "主要财务指标")
ADJUSTED = {"调整前": "before", "调整后": "after"}
PRIOR = ("上年同期", "上年度", "上期")
SCOPES = {"母公司": "parent", "子公司": "subsidiary", "合并": "consolidated"}
TERMS = "度|上半年|下半年|半年度|第一季度|第二季度|第三季度|第四季度|一季度|二季度|三季度|四季度|前三季度"
_PERIOD = re.compile(rf"(?:19|20)[0-9]{{2}}(?:年(?:{TERMS})?|[-/][0-9]{{1,2}})?")


def spelt(period: str | None) -> str:
    """A period in one spelling: bare years and reports' years as years, half years and quarters by their full names."""
    p = re.sub(r"\s", "", period or "")
    p = re.sub("年(一|二|三|四)季度$", r"年第\1季度", re.sub("半年度$", "上半年", p))
    p = re.sub("年(?:度|报)$", "年", p)
    return f"{p}年" if re.fullmatch("(?:19|20)[0-9]{2}", p) else p


def periods_in(text: str) -> list[str]:
    return [spelt(m[0]) for m in _PERIOD.finditer(text)]


def year_before(period: str) -> str:
    return f"{int(period[:4]) - 1}{period[4:]}" if re.match("(?:19|20)[0-9]{2}", period) else ""


def _scope(text: str) -> str:
    return next((s for w, s in SCOPES.items() if w in text), "")


def _adjustment(text: str) -> str:
    told = {a for w, a in ADJUSTED.items() if w in text}
    return told.pop() if len(told) == 1 else ""


def _finer(period: str, other: str) -> str:
    """``other`` if it is of the same year and says more."""
    return other if period and other[:4] == period[:4] and len(other) > len(period) else period


@dataclass
class Row:
    """The numbers behind a label, by their order, and the header above it."""

    metric: str
    label_end: int
    starts: list[int]

    def place(self, start: int) -> int:
        return self.starts.index(start) if start in self.starts else -1


class Reading:
    """A text with its numbers, its metric names and the rows that they form."""

    def __init__(self, text: str, is_table: bool = False):
        self.text = normalised(text)
        self.numbers = claims_of(text)
        self.named = mentions(self.text)
        self.table = is_table or ("|" in self.text and "\n" in self.text) or bool(TABLE.search(re.sub(r"\s", "", self.text)))

    def above(self, start: int) -> str:
        """The nearest name before a number on its line, else in up to four lines above it."""
        line = self.text.rfind("\n", 0, start) + 1
        if own := _nearest([x for x in self.named if x[0] >= line], start, start):
            return own
        bound = line
        for _ in range(ABOVE_LINES):
            if not bound or start - (up := self.text.rfind("\n", 0, bound - 1) + 1) > ABOVE:
                break
            bound = up
        return _nearest([x for x in self.named if x[0] >= bound], start, start) if bound < line else ""

    def _behind_label(self, start: int, metric: str | None) -> tuple[int, int, str] | None:
        """The last name (of a metric) before a number, if no other stands in between and it is not far."""
        before = [x for x in self.named if x[1] <= start and metric in (None, x[2])]
        after = min((x[0] for x in self.named if x[0] > start), default=len(self.text))
        return before[-1] if before and start < after and start - before[-1][1] <= ROW else None

    def row_metric(self, start: int) -> str:
        found = self._behind_label(start, None)
        return found[2] if found else ""

    def row(self, start: int, metric: str) -> Row | None:
        """The row of a number: from its label, or from the line above that holds no digit, to the next such line or name."""
        label = self._behind_label(start, metric) if metric else None
        if label is None:
            return None
        lo, hi = label[1], min((x[0] for x in self.named if x[0] > start), default=len(self.text))
        lines = [(m.start(), m.end(), m[0].strip()) for m in re.finditer(r"[^\n]*(?:\n|$)", self.text)]
        at = next(k for k, (s, e, _) in enumerate(lines) if s <= start < e)
        if not re.search("[0-9]", self.text[lines[at][0] : start]):
            words = [k for k, (_, _, t) in enumerate(lines) if t and not re.search("[0-9]", t)]
            if upper := [k for k in words if k < at]:
                lo = lines[upper[-1]][1]
                hi = next((lines[k][0] for k in words if k > at), len(self.text))
        return Row(metric, label[1], [c["start"] for c in self.numbers if lo <= c["start"] < hi])

    def _header(self, row: Row) -> tuple[str, str]:
        """The text above a row's values from its key table's title on, and what stands before that."""
        head = self.text[: row.label_end]
        at = max(head.rfind(w) for w in KEY_TABLES)
        return (head[at:], head[:at]) if at >= 0 else (head, "")

    def share_place(self, row: Row) -> int:
        """Which of a row's numbers its change column holds, -1 if the header has none."""
        head = re.sub(r"\s", "", self.text[: row.label_end])
        if not row.starts or not CHANGE.search(head):
            return -1
        if all(w in head for w in ADJUSTED) and len(row.starts) >= 4:
            return 3  # this period, the last one twice, the change
        dated = periods_in(self.text[: row.label_end])[-4:]
        return len(dated) - 1 if len(dated) >= 2 else len(row.starts) - 1

    def is_share(self, row: Row | None, start: int) -> bool:
        last = self.named and [x for x in self.named if x[1] <= start]
        return bool(row and last and last[-1][2] == row.metric and row.place(start) >= 0 and row.place(start) == self.share_place(row))

    def period(self, row: Row | None, start: int, stored: str) -> str:
        """The period of the column that a number stands in; ``stored`` is the passage's own."""
        if row is None or (place := row.place(start)) < 0 or self.is_share(row, start):
            return ""
        head, before = self._header(row)
        dated = periods_in(head)[-4:]
        amount = place - (0 <= self.share_place(row) < place)
        if all(w in head for w in ADJUSTED) and len(row.starts) >= 4:
            earlier = periods_in(before)
            columns = [*dated[:1], *(2 * dated[1:2])]
            if len(columns) == 3:
                columns.append(earlier[-1] if earlier else year_before(dated[1]))
            own = columns[min(amount, 3)] if amount < len(columns) or len(columns) == 4 else ""
        else:
            own = dated[amount] if amount < len(dated) else ""
        if own:
            return _finer(own, stored)
        if amount == 1 and any(w in head + before for w in PRIOR):
            return year_before(stored)
        return stored if amount == 0 else ""

    def adjustment(self, start: int, metric: str) -> str:
        """before or after, by the header cell of a number's column."""
        label = self._behind_label(start, metric) if metric else None
        if label is None:
            return ""
        hi = min((x[0] for x in self.named if x[0] > start), default=len(self.text))
        order = [c["start"] for c in self.numbers if label[1] <= c["start"] < hi]
        for line in self.text[: label[1]].splitlines():
            cells = [c.strip() for c in line.strip().strip("|").split("|")] if "|" in line else []
            column = order.index(start) + 1 if start in order else 0
            if 0 < column < len(cells) and (told := next((a for w, a in ADJUSTED.items() if w in cells[column]), "")):
                return told
        return ""

    def bound(self, question: str = "", period: str = "", scope: str = "", fallback: Iterable[str] = (), is_evidence: bool = True) -> list[dict]:
        """The numbers with metric, period, scope and adjustment. ``period``, ``scope``, ``fallback``: of the passage that they stand in."""
        asked, stored, fallback, out = periods_in(question), spelt(period), list(fallback), []
        for c in self.numbers:
            start, c = c["start"], dict(c)
            loose = self.above(start)
            year = not c["unit"] and c["number"] == c["number"].to_integral_value() and 1900 <= c["number"] <= 2100
            c["metric"] = c["metric"] or loose or self.row_metric(start) or (fallback[0] if len(fallback) == 1 and not year else "")
            row = self.row(start, c["metric"]) if self.table else None
            if self.is_share(row, start):
                if not c["is_percent"]:
                    c |= {"unit": "%", "is_percent": True, "canonical_value": c["number"]}
                own = asked[0] if asked else ""
            else:
                near = periods_in(self.text[max(0, start - DATED) : start])
                own = _finer(self.period(row, start, stored) or (near[-1] if near else ""), stored)
                if c["is_percent"] and len(asked) > 1:
                    own = asked[0]  # a change is that of the first period that is asked for
            before = self.text[max(0, start - CONTEXT) : start]
            dated = periods_in(before)
            own = own or (dated[-1] if dated else "") or (asked[0] if len(asked) == 1 else "") or stored
            told = _scope(re.sub(r"\s", "", before)) or ("" if scope in ("", "unknown") else scope) or ("" if is_evidence else _scope(question))
            adjusted = (self.adjustment(start, c["metric"]) if self.table else "") or _adjustment(question)
            out.append(c | {"period": own, "scope": told, "adjustment": adjusted})
        return out


BOUND = "array<struct<raw: string, number: decimal(30,6), unit: string, canonical_value: decimal(38,6), is_percent: boolean, metric: string, period: string, scope: string, adjustment: string, start: int, end: int>>"
_FIELDS = ("raw", "number", "unit", "canonical_value", "is_percent", "metric", "period", "scope", "adjustment", "start", "end")


def _evidence(texts: pd.Series, questions: pd.Series, periods: pd.Series, scopes: pd.Series, tables: pd.Series, fallback: pd.Series) -> pd.Series:
    rows = zip(texts, questions, periods, scopes, tables, fallback)
    return pd.Series([[{f: c[f] for f in _FIELDS} for c in Reading(t or "", bool(k)).bound(q or "", p or "", s or "", f if f is not None else ())] for t, q, p, s, k, f in rows], dtype=object)


def _answers(texts: pd.Series, questions: pd.Series) -> pd.Series:
    return pd.Series([[{f: c[f] for f in _FIELDS} for c in Reading(t or "").bound(q or "", is_evidence=False)] for t, q in zip(texts, questions)], dtype=object)


def evidence_claims(text: Column, question: Column, period: Column, scope: Column, is_table: Column, fallback: Column) -> Column:
    """The numbers of a passage with all that binds them; ``fallback``: the metrics that its fields name."""
    return F.pandas_udf(_evidence, BOUND)(text, question, period, scope, is_table, fallback)


def answer_claims(answer: Column, question: Column) -> Column:
    return F.pandas_udf(_answers, BOUND)(answer, question)
