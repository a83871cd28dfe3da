"""Metric records of entities by period: latest record, year over year, peers, findings.

Records: entity, period_year int, period_type, scope, metric, value decimal(20,6), status, updated_at, id.
Latest records are aggregated before they are shuffled, and gathered into one row per entity and year, a map
from the few metrics to their records. What compares years or peers reads such rows once: the year before is
the row before, and a group's members stand in one row of their group and year.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up

#: The five metrics in their order.
METRICS = ("revenue", "net_profit_parent", "operating_cash_flow", "total_assets", "total_liabilities")
KEY = ("entity", "period_year", "metric")


def latest(records: DataFrame, key=KEY) -> DataFrame:
    """One record a key, the last by (updated_at, id), and whether there were more."""
    rest = [c for c in records.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct("updated_at", "id")).alias("r")
    return records.groupBy(*key).agg(best, (F.count("*") > 1).alias("duplicate")).select(*key, "r.*", "duplicate")


def yearly(records: DataFrame) -> DataFrame:
    """(entity, period_year, own, prev): the latest record of each metric, of the year and of the year before."""
    rest = [c for c in ("value", "period_type", "scope", "status", "duplicate") if c in (*records.columns, "duplicate")]
    own = F.map_from_entries(F.collect_list(F.struct("metric", F.struct(*rest))))
    rows = latest(records).filter("metric IS NOT NULL").groupBy("entity", "period_year").agg(own.alias("own"))
    w = Window.partitionBy("entity").orderBy("period_year")
    before = F.lag("period_year").over(w) == F.col("period_year") - 1
    return rows.withColumn("prev", F.when(before, F.lag("own").over(w)))


def pivoted(records: DataFrame, metrics=METRICS) -> DataFrame:
    """A row per entity and year with a column per metric."""
    return records.groupBy("entity", "period_year").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def compared(records: DataFrame) -> DataFrame:
    """Each latest record with that of the year before: comparable, change_amount, change_rate, note."""
    fields = ("value", "period_type", "scope")
    both = yearly(records).select("entity", "period_year", "prev", F.explode("own").alias("metric", "o")).withColumn("p", F.element_at("prev", F.col("metric")))
    both = both.select(*KEY, *[F.col(f"o.{c}").alias(c) for c in fields], *[F.col(f"p.{c}").alias(f"prev_{c}") for c in fields], F.when(F.col("p").isNotNull(), True).alias("found"))
    note = (
        F.when(F.col("found").isNull(), "no comparison record")
        .when(~F.col("period_type").eqNullSafe(F.col("prev_period_type")), "period types differ")
        .when(~F.col("scope").eqNullSafe(F.col("prev_scope")), "scopes differ")
        .when(F.col("value").isNull() | F.col("prev_value").isNull(), "a value is missing")
    )
    comparable = note.isNull()
    zero = comparable & (F.col("prev_value") == 0)
    change = F.when(comparable, F.col("value") - F.col("prev_value"))
    rate = F.when(comparable & ~zero, (F.col("value").cast("double") - F.col("prev_value").cast("double")) / F.abs(F.col("prev_value").cast("double")) * 100)
    return both.select(
        *KEY, "value", "prev_value", comparable.alias("comparable"), change.cast("decimal(20,6)").alias("change_amount"),
        half_up(rate).cast("decimal(20,2)").alias("change_rate"), F.coalesce(note, F.when(zero, "the comparison value is zero"), F.lit("compared")).alias("note"),
    )


def relation(pivot: DataFrame, left: str = "net_profit_parent", right: str = "operating_cash_flow") -> DataFrame:
    """How ``right`` stands to ``left`` in each row: higher, lower, equal or unavailable."""
    d = F.col(right) - F.col(left)
    said = F.when(d > 0, "higher").when(d < 0, "lower").when(d == 0, "equal").otherwise("unavailable")
    return pivot.select("entity", "period_year", F.col(left).alias("left_value"), F.col(right).alias("right_value"), d.cast("decimal(20,6)").alias("difference"), said.alias("relation"))


def peers(records: DataFrame, groups: DataFrame) -> DataFrame:
    """The peers of each group on every metric of their year: comparable, note, bar percent, leader.

    ``groups`` (grp, entity): small sets of entities to be compared, which stand in one row. A metric of a group is comparable if
    none of its peers lacks it, no record is in conflict or failed, and period types and scopes agree, in
    that order of precedence. A bar is the share of the largest magnitude.
    """
    every = groups.join(yearly(records).select("entity", "period_year", "own"), "entity").groupBy("grp", "period_year").agg(F.map_from_entries(F.collect_list(F.struct("entity", "own"))).alias("every"))
    members = groups.groupBy("grp").agg(F.collect_set("entity").alias("members"))
    names = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    rows = every.join(members, "grp").select("grp", "period_year", "every", F.explode("members").alias("entity")).select("grp", "period_year", "entity", F.element_at("every", F.col("entity")).alias("own"), names)
    rows = rows.select("grp", "period_year", "entity", "metric", F.element_at("own", F.col("metric")).alias("r")).select("grp", "period_year", "entity", "metric", *[F.col(f"r.{c}").alias(c) for c in ("value", "period_type", "scope", "status")])
    of = Window.partitionBy("grp", "period_year", "metric")
    missing = F.max(F.col("value").isNull()).over(of)
    broken = F.max(F.coalesce(F.col("status").isin("conflict", "failed"), F.lit(False))).over(of)

    def differ(c):
        return F.min(c).over(of) != F.max(c).over(of)

    types, scopes = F.coalesce(differ("period_type"), F.lit(False)), F.coalesce(differ("scope"), F.lit(False))
    note = F.when(missing, "missing").when(broken, "conflict").when(types, "period types differ").when(scopes, "scopes differ").otherwise("comparable")
    rows = rows.withColumn("note", note).withColumn("comparable", F.col("note") == "comparable")
    most = F.max(F.abs("value")).over(of)
    share = F.when(most == 0, F.lit(0.0)).otherwise(F.abs("value").cast("double") / most.cast("double") * 100)
    rows = rows.withColumn("bar_percent", F.when(F.col("comparable"), half_up(share)).cast("decimal(20,2)"))
    lead = F.when(F.col("comparable"), F.col("value") == F.max("value").over(of))
    lag = F.when(F.col("comparable"), F.col("value") == F.min("value").over(of))
    spread = F.when(F.col("comparable"), F.max("value").over(of) - F.min("value").over(of)).cast("decimal(20,6)")
    return rows.select("grp", "period_year", "metric", "entity", "value", "comparable", "note", "bar_percent", lead.alias("leader"), lag.alias("laggard"), spread.alias("spread"))


def findings(records: DataFrame) -> DataFrame:
    """Coded findings of each entity and year, one row each: duplicates, missing or empty current and comparison metrics, mismatches, zero bases."""
    names = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    rows = yearly(records).select("entity", "period_year", "own", "prev", names)
    rows = rows.select("entity", "period_year", "metric", F.element_at("own", F.col("metric")).alias("o"), F.element_at("prev", F.col("metric")).alias("p"))
    fields = ("value", "period_type", "scope")
    rows = rows.select(
        "entity", "period_year", "metric", *[F.col(f"o.{c}").alias(c) for c in (*fields, "duplicate")], *[F.col(f"p.{c}").alias(f"prev_{c}") for c in fields],
        F.when(F.col("o").isNotNull(), True).alias("found"), F.when(F.col("p").isNotNull(), True).alias("prev_found"),
    )
    both = F.col("found") & F.col("prev_found")
    same_type, same_scope = F.col("period_type").eqNullSafe(F.col("prev_period_type")), F.col("scope").eqNullSafe(F.col("prev_scope"))
    checks = (
        ("duplicate_metric", F.col("duplicate")),
        ("missing_current_metric", F.col("found").isNull()),
        ("missing_current_value", F.col("found") & F.col("value").isNull()),
        ("missing_comparison_metric", F.col("prev_found").isNull()),
        ("missing_comparison_value", F.col("prev_found") & F.col("prev_value").isNull()),
        ("period_type_mismatch", both & ~same_type),
        ("statement_scope_mismatch", both & same_type & ~same_scope),
        ("zero_comparison_base", both & same_type & same_scope & F.col("value").isNotNull() & (F.col("prev_value") == 0)),
    )
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in checks]))
    return rows.select("entity", "period_year", "metric", F.explode(codes).alias("code"))


def seeded(stored: DataFrame, seed: DataFrame, key=("kb_id", "company_name", "report_period", "metric_code")) -> DataFrame:
    """``stored`` with those rows of ``seed`` whose key it lacks."""
    return stored.unionByName(seed.join(stored.select(*key).distinct(), list(key), "left_anti"))


def page(df: DataFrame, where, limit: int, offset: int = 0, order: str = "id") -> DataFrame:
    """A page of the matching rows, the last first, with the count of all."""
    rows = df.filter(where)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc(order)).offset(offset).limit(limit).join(F.broadcast(total), how="cross")


def patched(stored: DataFrame, patch: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Updated rows, and a revision with old and new snapshots for each row that changed. Null in ``patch``: unchanged.

    Values tell a change, not their spelling: zero is zero whatever its sign, which the snapshots keep.
    """
    fields = [c for c in patch.columns if c != key]
    both = stored.alias("s").join(patch.alias("p"), key, "left")
    now = [F.coalesce(F.col(f"p.{c}"), F.col(f"s.{c}")).alias(c) if c in fields else F.col(f"s.{c}").alias(c) for c in stored.columns if c != key]
    new = both.select(key, *now)
    later = {c: F.coalesce(F.col(f"p.{c}"), F.col(f"s.{c}")) for c in fields}
    old, after = F.to_json(F.struct(*[F.col(f"s.{c}") for c in fields])), F.to_json(F.struct(*[v.alias(c) for c, v in later.items()]))
    differs = functools.reduce(Column.__or__, [~v.eqNullSafe(F.col(f"s.{c}")) for c, v in later.items()], F.lit(False))
    return new, both.filter(differs).select(key, old.alias("old_snapshot"), after.alias("new_snapshot"))


def disclosures(records: DataFrame) -> DataFrame:
    """(entity, period_year, disclosures): where each present metric's latest record is from, in the metrics' order."""
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    item = F.struct(order.alias("_at"), "metric", F.coalesce("source_title", F.lit("")).alias("source_title"), "source_page", "source_page_end", F.coalesce("source_text", F.lit("")).alias("source_text"))
    found = latest(records).filter(F.col("metric").isin(*METRICS)).groupBy("entity", "period_year").agg(F.array_sort(F.collect_list(item)).alias("items"))  # one a metric at most
    return found.select("entity", "period_year", F.transform("items", lambda x: x.dropFields("_at")).alias("disclosures"))


def analysed(records: DataFrame) -> DataFrame:
    """One row per entity and year: its metrics compared, profit against cash flow, disclosures, findings."""
    key = ["entity", "period_year"]
    cells = F.struct("metric", "value", "prev_value", "comparable", "change_amount", "change_rate", "note")
    compared_ = compared(records).groupBy(*key).agg(F.array_sort(F.collect_list(cells)).alias("metrics"))
    related = relation(pivoted(latest(records))).select(*key, F.struct("left_value", "right_value", "difference", "relation").alias("profit_cash_flow"))
    pending = findings(records).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("metric", "code"))).alias("pending"))
    return compared_.join(related, key).join(disclosures(records), key, "left").join(pending, key, "left")


def written(brief: Column, template: Column) -> tuple[Column, Column]:
    """A model's text and where it is from; a null or blank one gives way to the template."""
    good = F.coalesce(F.trim(brief) != "", F.lit(False))
    return F.when(good, brief).otherwise(template), F.when(good, "llm").otherwise("template")


def company_markdown(rows: DataFrame) -> DataFrame:
    """A Markdown table of each entity's compared metrics (as :func:`compared` gives them)."""

    def cell(c):
        return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("—")), "\\|", "\\\\\\\\|"), "\\n", "<br>")

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in ("metric", "value", "prev_value", "change_amount", "change_rate", "note")]), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"]), "\n")
    head = "| metric | value | before | change | rate | note |\n| --- | --- | --- | --- | --- | --- |\n"
    return rows.groupBy("entity", "period_year").agg(F.concat(F.lit(head), lines).alias("markdown"))


def company_brief(compared_rows: DataFrame, related: DataFrame, pending: DataFrame) -> DataFrame:
    """A fixed Markdown brief of each entity and year: its metrics, profit against cash flow, findings."""
    value = F.coalesce(F.col("value").cast("string"), F.lit("—"))
    line = F.concat(F.lit("- **"), F.col("metric"), F.lit("**: "), value, F.lit(" ("), F.col("note"), F.lit(")"))
    lines = compared_rows.groupBy("entity", "period_year").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("metrics"))
    todo = pending.groupBy("entity", "period_year").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("metric"), F.lit(": "), F.col("code")))), "\n").alias("todo"))
    both = lines.join(related.select("entity", "period_year", "relation"), ["entity", "period_year"], "left").join(todo, ["entity", "period_year"], "left")
    text = F.concat(
        F.lit("# Company brief\n\n## "), F.col("entity"), F.lit(" "), F.col("period_year").cast("string"), F.lit("\n\n"), F.col("metrics"), F.lit("\n\n## Profit and cash flow\n\n- "),
        F.coalesce("relation", F.lit("unavailable")), F.lit("\n\n## To be checked\n\n"), F.coalesce("todo", F.lit("- none")), F.lit("\n"),
    )
    return both.select("entity", "period_year", text.alias("brief"))


def peer_brief(rows: DataFrame) -> DataFrame:
    """A fixed line per group, year and metric: who leads whom by how much, ties and all, or why it cannot be compared."""
    names = {side: F.array_join(F.array_sort(F.collect_list(F.when(F.col(side), F.col("entity")))), ", ") for side in ("leader", "laggard")}
    sums = rows.groupBy("grp", "period_year", "metric").agg(F.first("comparable").alias("comparable"), F.first("note").alias("note"), names["leader"].alias("high"), names["laggard"].alias("low"), F.first("spread").alias("spread"))
    said = F.when(~F.col("comparable"), F.concat(F.lit("not comparable: "), F.col("note"))).when(F.col("spread") == 0, F.concat(F.col("high"), F.lit(": equal"))).otherwise(F.concat(F.col("high"), F.lit(" above "), F.col("low"), F.lit(" by "), F.col("spread").cast("string")))
    return sums.select("grp", "period_year", "metric", said.alias("line"))
