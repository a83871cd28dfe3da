"""Evaluation of retrieval: hits and recall with their own denominators, reports, diffs and gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed

KS = (1, 3, 5)
SMALL_SAMPLE = 10


def case_scores(expected: DataFrame, hits: DataFrame, ks: Iterable[int] = KS) -> DataFrame:
    """A row per case: hit_at_k and recall_at_k for each k, the count of expected documents, and a status.

    ``expected`` (case_id, doc; a null doc for a case without truth), ``hits`` (case_id, doc, rank from 0).
    """
    best = hits.groupBy("case_id", "doc").agg(F.min("rank").alias("rank"))
    both = expected.join(best, ["case_id", "doc"], "left")
    n = F.count("doc")
    out = [n.alias("n_expected")]
    for k in ks:
        found = F.count_if(F.col("rank") < k)
        out += [F.when(n > 0, (found > 0).cast("int")).alias(f"hit_at_{k}"), F.when(n > 0, F.round(found / n, 4)).alias(f"recall_at_{k}")]
    scores = both.groupBy("case_id").agg(*out)
    any_hit = hits.select("case_id").distinct().withColumn("_hits", F.lit(True))
    status = F.when(F.col("n_expected") == 0, "not_scoreable").when(F.col("_hits").isNull(), "retrieval_failure").otherwise("scored")
    return scores.join(any_hit, "case_id", "left").withColumn("status", status).drop("_hits")


def means(scores: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(metric, value, denominator): each mean over the cases that have the metric."""
    columns = list(columns)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    return scores.select(parts).groupBy("x.metric").agg(F.round(F.avg("x.v"), 4).alias("value"), F.count("x.v").alias("denominator"))


def evidence_found(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, evidence_rate): the share of expected excerpts that some hit's text holds, white space and case aside."""
    both = evidence.join(hits.select("case_id", squeezed(F.col("text")).alias("hay")), "case_id", "left")
    held = both.groupBy("case_id", "excerpt").agg(F.max(F.coalesce(F.col("hay").contains(squeezed(F.col("excerpt"))), F.lit(False))).alias("held"))
    return held.groupBy("case_id").agg(F.round(F.avg(F.col("held").cast("double")), 4).alias("evidence_rate"))


def summary(results: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Pass rate, answerable accuracy and latencies (nearest rank) of results (passed, answerable_ok, latency)."""
    latency = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency)").alias(f"p{int(q * 100)}") for q in (0.5, 0.95)]
    figures = [
        F.count("*").alias("total"), F.count_if("passed").alias("n_passed"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"),
        F.round(F.avg(F.col("answerable_ok").cast("double")), 4).alias("answerable_accuracy"), F.round(F.avg("latency"), 3).alias("latency_avg"), F.round(F.max("latency"), 3).alias("latency_max"), *latency,
    ]
    return results.groupBy(*by).agg(*figures) if by else results.agg(*figures)


def service_summary(results: DataFrame) -> DataFrame:
    """(measure, hits, total, rate): of guardrail intents, answerability, FAQ hits and keywords, over the cases that expect one; null without any.

    ``results`` (intent, escalate, faq_hit, answer, expect_intent, expect_answerable, expect_faq, expect_keyword); a null expectation is none.
    """
    met = {
        "intent": (F.col("expect_intent"), F.col("intent").eqNullSafe(F.col("expect_intent"))),
        "answerable": (F.col("expect_answerable"), ~F.coalesce("escalate", F.lit(False)) == F.col("expect_answerable")),
        "faq": (F.col("expect_faq"), F.coalesce("faq_hit", F.lit(False)) == F.col("expect_faq")),
        "keyword": (F.col("expect_keyword"), F.coalesce(F.col("answer").contains(F.col("expect_keyword")), F.lit(False))),
    }
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.when(e.isNotNull(), ok).alias("ok")) for m, (e, ok) in met.items()])
    sums = results.select(F.inline(each)).groupBy("measure").agg(F.count_if("ok").alias("hits"), F.count("ok").alias("total"))
    return sums.withColumn("rate", F.round(F.try_divide("hits", "total"), 4))


def offline_totals(found: DataFrame, ks: Iterable[int]) -> DataFrame:
    """(measure, k, hits, total): cases with the right document, excerpt or page among the first k hits, of those that have such a truth.

    ``found`` (case_id, measure, rank): the best rank of a right hit from 0, null if there is none.
    """
    best = found.groupBy("case_id", "measure").agg(F.min("rank").alias("rank"))
    each = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return best.select("measure", "rank", each).groupBy("measure", "k").agg(F.count_if(F.col("rank") < F.col("k")).alias("hits"), F.count("*").alias("total"))


def slices(results: DataFrame) -> DataFrame:
    """Totals by category and by tag, a case with several tags in each: (kind, name, total, n_passed)."""
    by = F.explode(F.concat(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name"))), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name"))))).alias("s")
    return results.select("passed", by).groupBy("s.kind", "s.name").agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"))


def report_diff(base: DataFrame, new: DataFrame, lower_is_better: Iterable[str] = ()) -> DataFrame:
    """Metrics of two reports (metric, value, denominator): status, change, verdict, warnings."""
    b, n = base.alias("b"), new.alias("n")
    both = b.join(n, F.col("b.metric") == F.col("n.metric"), "full")
    delta = F.round(F.col("n.value") - F.col("b.value"), 4)
    gain = F.when(F.col("metric").isin(list(lower_is_better)), -F.col("delta")).otherwise(F.col("delta"))
    status = F.when(F.col("b.metric").isNull() | F.col("n.metric").isNull(), "missing").when(F.col("b.value").isNull() | F.col("n.value").isNull(), "not_scoreable").otherwise("ok")
    rows = both.select(
        F.coalesce("b.metric", "n.metric").alias("metric"), F.col("b.value").alias("base_value"), F.col("n.value").alias("new_value"), delta.alias("delta"), status.alias("status"),
        (~F.col("b.denominator").eqNullSafe(F.col("n.denominator"))).alias("denominators_differ"), F.coalesce(F.least("b.denominator", "n.denominator") < SMALL_SAMPLE, F.lit(False)).alias("small_sample"),
    )
    verdict = F.when(F.col("status") != "ok", F.col("status")).when(gain > 0, "better").when(gain < 0, "worse").otherwise("same")
    return rows.withColumn("verdict", verdict)


def gates(diff: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (metric, kind, bound): require a gain of bound, or limit a regression to it; a missing metric fails."""
    both = rules.join(diff, "metric", "left")
    passed = F.when(F.col("kind") == "require_gain", F.col("delta") >= F.col("bound")).otherwise(F.col("delta") >= -F.col("bound"))
    return both.select("metric", "kind", "bound", "delta", F.coalesce((F.col("status") == "ok") & passed, F.lit(False)).alias("passed"))


def stability(runs: DataFrame) -> DataFrame:
    """Cases over repeated runs: stable pass, stable fail, or flaky."""
    n = runs.groupBy("case_id").agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_runs"))
    said = F.when(F.col("n_passed") == F.col("n_runs"), "stable_pass").when(F.col("n_passed") == 0, "stable_fail").otherwise("flaky")
    return n.withColumn("stability", said)


def recall_bucket(rank: Column) -> Column:
    """Where an expected block stands: top5, top10, top20, later or absent."""
    return F.when(rank.isNull(), "absent").when(rank < 5, "top5").when(rank < 10, "top10").when(rank < 20, "top20").otherwise("later")


def unlike_ids(a: DataFrame, b: DataFrame, key: str = "case_id") -> DataFrame:
    """Ids that only one of two sets has: (id, side)."""
    return a.select(key).distinct().withColumn("l", F.lit(1)).join(b.select(key).distinct().withColumn("r", F.lit(1)), key, "full").filter("l IS NULL OR r IS NULL").select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))
