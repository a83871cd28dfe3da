"""Case-level checks and release gates of the evaluation: sources, numbers, answers, baselines, diagnoses."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, squeezed
from . import substrings
from .verify import claims_of

# Endings that a document's name may lose.
ENDINGS = "pdf docx doc txt md csv xlsx xls pptx ppt".split()


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), "\\\\", "/"), "([^/]*)/*$", 1))


def source_keys(path: Column) -> Column:
    """By what a source can be met: its name, and its name without a known ending."""
    name = file_name(path)
    stem = F.regexp_replace(name, f"(?<=.)\\.({'|'.join(ENDINGS)})$", "")
    return F.array_distinct(F.filter(F.array(name, stem), lambda k: k != ""))


def sources_met(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, source, rank): the best rank of a hit whose id is the source or whose name is its name. Keys meet by equality."""
    want = expected.select("case_id", "source", F.explode(F.array_union(F.array("source"), source_keys(F.col("source")))).alias("key"))
    have = hits.select("case_id", "rank", F.explode(F.array_union(F.array("doc"), source_keys(F.col("title")))).alias("key"))
    return want.join(have, ["case_id", "key"], "left").groupBy("case_id", "source").agg(F.min("rank").alias("rank"))


def numbers_match(expected: str | None, answer: str | None, tolerance: float = 0.0) -> bool:
    """Whether an answer states what is expected: each number of it in any unit, exactly or as rounded in the answer, or the words if it has none.

    A share never stands for an amount. ``tolerance``: relative difference allowed between amounts.
    """
    if not expected:
        return True
    want, have = claims_of(expected), claims_of(answer or "")
    if not want:
        return "".join(expected.split()).casefold() in "".join((answer or "").split()).casefold()

    def same(w, h):
        if w["is_percent"] != h["is_percent"]:
            return False
        if w["canonical_value"] == h["canonical_value"]:
            return True
        if w["is_percent"] or not h["canonical_value"]:
            return False
        if tolerance and abs(w["canonical_value"] - h["canonical_value"]) < abs(h["canonical_value"]) * Decimal(str(tolerance)):
            return True
        scale = h["canonical_value"] / h["number"]
        # a figure in a larger unit stands for what rounds to it, if it has decimals of its own
        digits = h["number"].as_tuple().exponent
        return scale > 1 and digits < 0 and (w["canonical_value"] / scale).quantize(Decimal(1).scaleb(digits), ROUND_HALF_UP) == h["number"]

    return all(any(same(w, h) for h in have) for w in want)


def _matches(expected: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([numbers_match(e, a) for e, a in zip(expected, answers)], dtype=bool)


def keyword_match(expected: Column, answer: Column) -> Column:
    return F.pandas_udf(_matches, "boolean")(expected, answer)


def answer_checks(cases: DataFrame) -> DataFrame:
    """Cases with a map of checks and whether all hold; a check whose expectation is null is left out.

    Columns: answer, citation_indices, citation_kbs, kb_id, escalate, intent, score, top_score, elapsed, and
    expect_answerable, expect_intent, expect_all, expect_any, forbidden, min_citations, max_citations,
    expect_inline, min_score, min_top_score, max_elapsed.
    """
    n = F.size("citation_indices")
    refs = F.transform(F.regexp_extract_all("answer", F.lit("\\[([0-9]+)\\]"), 1), lambda x: x.try_cast("int"))
    low = squeezed(F.col("answer"))

    def held(word):
        return low.contains(squeezed(word))

    checks = {
        "citation_indices": (n == 0) | (F.col("citation_indices") == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))),
        "kb_isolation": F.forall("citation_kbs", lambda k: k.eqNullSafe(F.col("kb_id"))),
        "no_citations_on_escalate": ~F.col("escalate") | (n == 0),
        "answerable": ~F.col("escalate") == F.col("expect_answerable"),
        "intent": F.when(F.col("expect_intent").isNotNull(), F.col("intent").eqNullSafe(F.col("expect_intent"))),
        "keywords_all": F.forall("expect_all", held),
        "keywords_any": F.exists("expect_any", held),
        "forbidden": ~F.exists("forbidden", held),
        "min_citations": n >= F.col("min_citations"),
        "max_citations": n <= F.col("max_citations"),
        "inline": F.when(F.col("expect_inline"), (F.size(refs) > 0) & F.forall(refs, lambda r: (r >= 1) & (r <= n))),
        "faithfulness": F.when(F.col("min_score").isNotNull(), F.coalesce("score", F.lit(0.0)) >= F.col("min_score")),
        "top_score": F.when(F.col("min_top_score").isNotNull(), F.coalesce("top_score", F.lit(0.0)) >= F.col("min_top_score")),
        "latency": F.col("elapsed") <= F.col("max_elapsed"),
    }
    made = F.map_filter(F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())
    return cases.withColumn("checks", made).withColumn("passed", F.forall(F.map_values("checks"), lambda v: v))


def baseline_findings(results: DataFrame, expected: DataFrame, min_passed: int) -> DataFrame:
    """(finding, case_id): missing, unexpected and repeated cases, cases that passed in the baseline and no longer do, too few passes.

    ``results`` (case_id, passed), ``expected`` (case_id, baseline_passed).
    """
    e, r = expected.alias("e"), results.groupBy("case_id").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"), F.count("*").alias("n")).alias("r")
    both = e.join(r, F.col("e.case_id") == F.col("r.case_id"), "full")
    said = F.array_compact(F.array(
        F.when(F.col("r.case_id").isNull(), F.lit("missing")), F.when(F.col("e.case_id").isNull(), F.lit("unexpected")), F.when(F.col("n") > 1, F.lit("repeated")),
        F.when(F.col("baseline_passed") & ~F.coalesce("passed", F.lit(False)), F.lit("regressed")),
    ))
    rows = both.select(F.explode(said).alias("finding"), F.coalesce("e.case_id", "r.case_id").alias("case_id"))
    few = results.agg(F.count_if("passed").alias("n")).filter(F.col("n") < min_passed).select(F.lit("too few passed").alias("finding"), F.lit(None).cast("string").alias("case_id"))
    return rows.select("finding", F.col("case_id").cast("string")).unionByName(few)


def required(results: DataFrame, ids: list[str], kb_id: str) -> DataFrame:
    """(case_id, finding) of required cases that are missing, failed, or cite another knowledge base; results (case_id, passed, citation_kbs)."""
    want = results.sparkSession.createDataFrame([(i,) for i in ids], "case_id string")
    both = want.join(results.withColumn("_there", F.lit(True)), "case_id", "left")
    foreign = F.exists("citation_kbs", lambda k: k.isNotNull() & (F.trim(k) != kb_id))
    said = F.when(F.col("_there").isNull(), "missing").when(~F.coalesce("passed", F.lit(False)), "failed").when(F.col("citation_kbs").isNull(), "no citations").when(foreign, "foreign citation")
    return both.select("case_id", said.alias("finding")).filter("finding IS NOT NULL")


def relaxed(checks: DataFrame, policies: dict[str, list[str]]) -> DataFrame:
    """How many cases would pass if each policy's checks did not count: (policy, n_passed, total)."""

    def passes(off):
        left = F.map_filter("checks", lambda k, _: ~k.isin(off) if off else F.lit(True))
        return F.count_if(F.forall(F.map_values(left), lambda v: v))

    counts = [passes(off).alias(p) for p, off in policies.items()]
    one = checks.agg(F.count("*").alias("total"), *counts)
    return one.select("total", F.explode(F.create_map(*[x for p in policies for x in (F.lit(p), F.col(p))])).alias("policy", "n_passed"))


def integrity(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, class): an expected excerpt is INTACT in some chunk, only its number is there, that is BROKEN, or it is MISSING.

    All excerpts, numbers and heads of numbers of ``evidence`` (item, excerpt) are looked for in one scan of the chunks.
    An empty excerpt is in every chunk.
    """
    number = F.regexp_extract("excerpt", "([-+]?[0-9][0-9,]*(?:\\.[0-9]+)?)", 1)
    ev = evidence.select("item", squeezed(F.col("excerpt")).alias("e"), number.alias("num"))
    head = F.left(F.regexp_replace("num", "[-+,]", ""), F.lit(6))
    kinds = F.array(F.struct(F.lit(3).alias("s"), F.col("e").alias("needle")), F.struct(F.lit(2).alias("s"), F.col("num").alias("needle")), F.struct(F.lit(1).alias("s"), head.alias("needle")))
    wanted = ev.select("item", F.inline(kinds))
    met = substrings.occurrences(chunks.select(F.lower("text").alias("text")), wanted, without=BLANKS).select("item", "s")
    anywhere = ev.filter("e = ''").select("item", F.lit(3).alias("s")).join(chunks.filter(F.col("text").isNotNull()).select(F.lit(3).alias("s")).limit(1), "s", "left_semi").select("item", "s")
    best = met.unionByName(anywhere).groupBy("item").agg(F.max("s").alias("s"))
    said = F.when(F.col("s") == 3, "INTACT").when(F.col("s") == 2, "NUMBER_ONLY").when(F.col("s") == 1, "BROKEN").otherwise("MISSING")
    return evidence.select("item").join(best, "item", "left").select("item", said.alias("class"))


def route_pools(questions: DataFrame, chunks: DataFrame, locked: DataFrame) -> DataFrame:
    """(query, period_pool, locked_pool, outcome): how many table chunks a route leaves, by period and then by locked documents.

    ``questions`` (query, period), ``chunks`` (doc, period, is_table), ``locked`` (query, doc).
    """
    asked = questions.select("query", "period").distinct()
    tables = chunks.filter("is_table").groupBy("doc", "period").agg(F.count("*").alias("n"))
    # a pool is as large for every query of its period, so queries meet periods and their own documents, never each other's
    by_period = asked.join(tables.groupBy("period").agg(F.sum("n").alias("n")), "period").groupBy("query").agg(F.sum("n").alias("period_pool"))
    own = asked.join(locked.select("query", "doc").distinct(), "query").join(tables, ["doc", "period"]).groupBy("query").agg(F.sum("n").alias("locked_pool"))
    sums = by_period.join(own, "query", "left")
    rows = questions.select("query").distinct().join(sums, "query", "left").na.fill(0, ["period_pool", "locked_pool"])
    return rows.withColumn("outcome", F.when(F.col("locked_pool") > 0, "routed").when(F.col("period_pool") > 0, "not in pool").otherwise("pool empty"))


def recognised(cases: DataFrame) -> DataFrame:
    """Recognition cases (text, min_chars, terms) with whether each passes: enough text, and all terms in it."""
    text = squeezed(F.coalesce("text", F.lit("")))
    return cases.withColumn("passed", (F.length(text) >= F.col("min_chars")) & F.forall("terms", lambda t: text.contains(squeezed(t))))
