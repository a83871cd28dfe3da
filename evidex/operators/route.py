"""The structured route: hits of the asked company's tables of the asked period, before what search finds by itself.

A route's pool is what its locked documents hold, so the joins are on query and document and the work follows
the pools, which are a few chunks a query. Inside a pool every choice is a window: a strict pass over tables of
the period, one for each metric that it lacks, a wider pass over the locked documents, and a bounded list of
their blocks in an order of their own. Relevance inside a pool is a Column that the caller gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import keep
from . import retrieval
from .retrieval import METRIC_GROUPS, any_of, bare, groups_in, groups_of

# How many hits each pass may take.
TOP, FALLBACK, ENUMERATED, NARRATIVE, RAW = 8, 32, 32, 8, 2
# Sections of key figures, words of a question that a route is for, and of half years.
KEY_SECTIONS = ("主要会计数据", "主要财务指标")
HINTS = ("营业收入", "营业总收入", "净利润", "归母净利润", "归属于上市公司股东的净利润", "研发投入", "研发费用", "现金流量净额", "资产总额", "负债总额", "每股收益", "毛利率", "净利率")
HALF_ASKED, HALF_TITLED = ("半年", "中期", "1-6"), ("半年", "上半年", "下半年", "中期")
FULL, SUMMARY = "全文", "摘要"
COMPANY_WORDS = ("公司", "股份", "集团")
#: A cause that is bound to a metric's name.
EXPLAINED = "(变动原因说明|原因说明)"


def periods_asked(text: Column) -> Column:
    """The annual or half-year periods that a question about metrics names, distinct, in order."""
    t = F.coalesce(text, F.lit(""))
    half = any_of(t, HALF_ASKED)
    years = F.regexp_extract_all(t, F.lit("(20[0-9]{2})\\s*年"), 1)
    return F.when(any_of(t, HINTS), F.array_distinct(F.transform(years, lambda y: F.concat(y, F.when(half, "年半年度").otherwise("年度"))))).otherwise(F.array().cast("array<string>"))


def has_number(text: Column) -> Column:
    """Whether a text holds a figure: not only years, page numbers, and six digits where nothing speaks of a company or metric."""
    t = F.coalesce(text, F.lit(""))
    context = any_of(t, HINTS) | any_of(t, COMPANY_WORDS) | t.contains("|")
    found = F.regexp_extract_all(t, F.lit("(?<![0-9])([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]+)?)(?![0-9])"), 1)

    def meant(x):
        digits = F.replace(x, F.lit(","), F.lit(""))
        whole = ~digits.contains(".")
        year = whole & digits.try_cast("int").between(1900, 2100)
        page = F.regexp_like(t, F.concat(F.lit("(第\\s*|页码\\s*)\\Q"), x, F.lit("\\E\\s*页?")))
        return ~F.coalesce(year, F.lit(False)) & ~page & ~(whole & (F.length(digits) == 6) & ~context)

    real = F.filter(found, meant)
    return (F.size(real) > 0) & (context | F.exists(real, lambda x: x.contains(".") | x.contains(",")))


def title_periods(title: Column) -> Column:
    """The periods that a document's name tells."""
    t = F.coalesce(title, F.lit(""))
    term = F.when(any_of(t, HALF_TITLED), "年半年度").otherwise("年度")
    return F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("((?:19|20)[0-9]{2})"), 1), lambda y: F.concat(y, term)))


def _subset(part: Column, whole: Column) -> Column:
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def pools(questions: DataFrame, chunks: DataFrame, locked: DataFrame, relevance: Column | None = None) -> DataFrame:
    """The chunks of each query's locked documents with all that the passes choose by.

    ``questions`` (query, text), ``locked`` (query, doc), ``chunks`` (chunk, doc, n, title, text, is_table, report_period,
    section_path, table_name, statement_scope, metrics: names of stored facts); n orders a corpus.
    ``relevance``: a Column over ``question``, ``wanted`` (the question with a metric's names) and the chunk's fields.
    """
    q = questions.select("query", F.col("text").alias("question"), retrieval.profile(F.col("text")).alias("p"), periods_asked(F.col("text")).alias("periods"))
    q = q.filter((F.size("periods") > 0) & (F.size("p.groups") > 0))
    known = chunks.groupBy("doc").agg(F.collect_set(F.when(F.col("report_period") != "", F.col("report_period"))).alias("stored"), F.array_distinct(F.flatten(F.collect_set(title_periods(F.col("title"))))).alias("titled"))
    known = known.select("doc", F.when(F.size("stored") > 0, F.col("stored")).otherwise(F.col("titled")).alias("doc_periods"))
    pool = q.join(locked.select("query", "doc").distinct(), "query").join(chunks, "doc").join(known, "doc")
    t, head, path = bare(F.col("text")), F.left(F.coalesce("text", F.lit("")), F.lit(240)), F.coalesce("section_path", F.lit(""))
    stored = groups_of(F.col("metrics"))
    met = F.array_intersect("p.groups", F.array_union(stored, groups_in(bare(F.concat(F.coalesce("table_name", F.lit("")), F.coalesce("text", F.lit("")))))))
    own = title_periods(F.col("title"))
    dated = F.when(F.coalesce("report_period", F.lit("")) != "", F.array_contains("periods", F.col("report_period")))
    dated = dated.otherwise(F.when(F.size(own) > 0, _subset(own, F.col("periods"))).otherwise(_subset(F.col("doc_periods"), F.col("periods"))))
    in_section = F.exists("p.sections", lambda s: path.contains(s) | head.contains(s))
    whole = F.col("question").contains(FULL) & F.col("question").contains(SUMMARY)
    told = retrieval.tells_cause(t)
    narrative = ((F.size("p.sections") > 0) | whole | F.col("p.is_cause")) & ((F.size("p.sections") == 0) | in_section) & (~F.col("p.is_cause") | told)
    preferred = F.array_union(F.array(*[F.lit(s) for s in KEY_SECTIONS]), F.col("p.sections"))
    bound = F.lit(False)
    for g, words in METRIC_GROUPS.items():
        bound = bound | (F.array_contains("p.groups", g) & t.rlike("(" + "|".join(words) + ").{0,24}" + EXPLAINED))
    cause = F.when(F.col("p.is_cause") & ~F.col("is_table") & told, F.when(bound, 2).otherwise(1)).otherwise(0)
    rows = pool.select(
        "query", "question", "p", "periods", "doc", "chunk", "n", "text", F.col("is_table"), met.alias("met"), F.size(F.array_intersect(stored, "p.groups")).alias("facts"),
        has_number(F.col("text")).alias("has_number"), F.coalesce(dated, F.lit(False)).alias("dated"), (path != "").alias("in_report"), in_section.alias("in_section"), narrative.alias("narrative"), whole.alias("whole"),
        F.array_contains("periods", F.col("report_period")).alias("stored_period"), F.size(F.filter(preferred, lambda s: path.contains(s))).alias("key_section"), cause.alias("cause"),
        F.aggregate(F.regexp_extract_all("question", F.lit("(" + "|".join(HINTS) + ")"), 1), F.lit(0), lambda s, w: s + F.col("text").contains(w).cast("int")).alias("metric_words"),
        retrieval.adjustment(F.col("p"), F.col("text"), stored, F.col("statement_scope"), F.col("is_table"), F.col("section_path"), F.col("table_name")).alias("adjustment"),
    )
    eligible = F.col("has_number") & F.col("dated") & (F.col("is_table") | F.col("narrative"))
    rows = rows.withColumn("eligible", eligible)
    score = relevance if relevance is not None else retrieval.overlap_score(F.col("wanted"), F.col("text"))
    names = F.create_map(*[x for g, words in METRIC_GROUPS.items() for x in (F.lit(g), F.lit(" ".join(sorted(words, key=len, reverse=True))))])
    sections = F.array_join(F.when(F.size("p.sections") > 0, F.col("p.sections")).otherwise(F.array(*[F.lit(s) for s in KEY_SECTIONS])), " ")
    # a metric's own query string for each asked group, the question itself for none
    each = F.explode(F.array_union(F.array(F.lit("")), F.col("p.groups"))).alias("grp")
    wide = rows.select("*", each).withColumn("wanted", F.when(F.col("grp") == "", F.col("question")).otherwise(F.concat_ws("\n", "question", F.concat(F.lit("财务指标："), names[F.col("grp")]), F.concat(F.lit("章节："), sections))))
    return wide.withColumn("relevance", score).drop("wanted")


def _first(rows: DataFrame, by: tuple[str, ...], order: list, most: int) -> DataFrame:
    """The first ``most`` of each group, with their places from 0 as ``at``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("at", F.row_number().over(w) - 1).filter(F.col("at") < most)


def structured(pool: DataFrame) -> DataFrame:
    """(query, chunk, place): the route's hits in its order, from 0. ``pool`` as :func:`pools` gives it."""
    best = [F.desc("relevance"), "n"]
    strict_pool = pool.filter("is_table AND stored_period AND in_report")
    met = F.size("met") > 0
    one = _first(strict_pool.filter("grp = ''"), ("query",), best, TOP).filter(met)
    found = one.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("found"), F.collect_set("doc").alias("found_docs"))
    asked = pool.select("query", "doc", F.col("p.groups").alias("groups"), F.size("p.sections").alias("n_sections"), "whole", F.col("p.is_cause").alias("is_cause")).distinct()
    asked = asked.join(found, "query", "left").withColumn("any", F.col("found").isNotNull()).withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    asked = asked.withColumn("found_docs", F.coalesce("found_docs", F.array().cast("array<string>")))
    missing = asked.filter("any").select("query", F.explode(F.array_except("groups", "found")).alias("grp")).distinct()
    two = _first(strict_pool.join(missing, ["query", "grp"]), ("query", "grp"), best, TOP).filter(F.array_contains("met", F.col("grp")))
    more = two.groupBy("query").agg(F.collect_set("grp").alias("more"))
    asked = asked.join(more, "query", "left").withColumn("lacks", F.array_except(F.array_except("groups", "found"), F.coalesce("more", F.array().cast("array<string>"))))
    # where the strict pass leaves gaps, the locked documents are searched one by one
    nothing, own_doc = ~F.col("any"), ~F.array_contains("found_docs", F.col("doc").cast("string"))
    by_question = nothing | (F.col("whole") & own_doc)
    by_group = F.col("any") & ~F.col("whole") & (F.size("lacks") > 0)
    by_section = (F.col("n_sections") > 0) & F.col("any") & (F.col("whole") | (F.size("lacks") == 0)) & ~(F.col("whole") & own_doc)
    requests = asked.select("query", "doc", F.explode(F.when(by_question | by_section, F.array(F.lit(""))).when(by_group, F.col("lacks")).otherwise(F.array().cast("array<string>"))).alias("grp"))
    three = _first(pool.join(requests, ["query", "doc", "grp"]), ("query", "doc", "grp"), best, FALLBACK).filter(F.col("eligible") & F.when(F.col("grp") == "", met).otherwise(F.array_contains("met", F.col("grp"))))
    got = three.select("query", F.explode("met").alias("grp"), F.col("grp").alias("by")).filter("by = '' OR by = grp").select("query", "grp").distinct()
    rest = asked.select("query", "doc", F.explode(F.when(nothing, F.col("groups")).otherwise(F.col("lacks"))).alias("grp")).join(got, ["query", "grp"], "left_anti").join(requests, ["query", "doc", "grp"], "left_anti")
    four = _first(pool.join(rest, ["query", "doc", "grp"]), ("query", "doc", "grp"), best, FALLBACK).filter(F.col("eligible") & F.array_contains("met", F.col("grp")))
    # blocks of the locked documents in an order of their own: for groups with gaps, or for all if there are none
    last = four.select("query", "grp").distinct()
    gaps = asked.select("query", F.explode(F.when(nothing, F.col("groups")).otherwise(F.col("lacks"))).alias("grp"), "any").distinct()
    open_gaps = gaps.filter("any").select("query", "grp").unionByName(gaps.filter("NOT any").select("query", "grp").join(got, ["query", "grp"], "left_anti").join(last, ["query", "grp"], "left_anti"))
    covered = asked.filter(F.col("any") & (F.size("lacks") == 0)).select("query", F.explode("groups").alias("grp")).distinct()
    ours = [F.desc(F.col("facts") > 0), F.desc(F.array_contains("met", F.col("grp"))), F.desc("key_section"), F.desc("adjustment"), "n"]
    fits = F.col("eligible") & F.array_contains("met", F.col("grp"))
    five = _first(pool.join(open_gaps.unionByName(covered).distinct(), ["query", "grp"]).filter(fits & F.col("is_table")), ("query", "grp"), ours, ENUMERATED)
    told = pool.filter((F.col("grp") != "") & ((F.size("p.sections") > 0) | F.col("p.is_cause")))
    six = _first(told.filter(fits & ~F.col("is_table") & ((F.size("p.sections") == 0) | F.col("in_section"))), ("query", "grp"), ours, NARRATIVE)
    fields = ["query", "chunk", "cause", "metric_words", "key_section", "has_number"]
    union = None
    for stage, rows in enumerate((one, two, five, six, three, four)):
        part = rows.select(*fields, F.struct(F.lit(stage).alias("stage"), F.col("grp").alias("grp"), F.col("doc").cast("string").alias("doc"), "at").alias("seen"))
        union = part if union is None else union.unionByName(part)
    hits = union.groupBy(*fields).agg(F.min("seen").alias("seen"))
    w = Window.partitionBy("query").orderBy(F.desc("cause"), F.desc("metric_words"), F.desc("key_section"), "seen")
    return hits.withColumn("place", F.row_number().over(w) - 1).select("query", "chunk", "place", "has_number")


def routed(ordered: DataFrame, pool: DataFrame) -> DataFrame:
    """(query, chunk, rank, source): at most two narratives of search that fit the route, the route's own hits, then search's order.

    ``ordered`` (query, chunk, rank). Without hits of its own the route changes nothing. The pools are kept,
    since each pass reads them.
    """
    pool = keep(pool, "route-pools")
    own = keep(structured(pool), "route-hits").filter("has_number").join(ordered.select("query", "chunk"), ["query", "chunk"], "left_anti")
    any_own = own.select("query").distinct().withColumn("_any", F.lit(True))
    fits = pool.filter("grp = '' AND NOT is_table AND has_number AND dated AND size(met) > 0").select("query", "chunk", F.lit(True).alias("_fits"))
    rows = ordered.join(any_own, "query", "left").join(fits, ["query", "chunk"], "left")
    raw = F.coalesce(F.col("_any") & F.col("_fits"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("query", "_raw").orderBy("rank"))
    rows = rows.withColumn("_raw", raw).withColumn("_keep", F.col("_raw") & (nth <= RAW))
    both = rows.select("query", "chunk", F.when(F.col("_keep"), 0).otherwise(2).alias("_part"), F.col("rank").alias("_at"), F.when(F.col("_keep"), "kept").otherwise("search").alias("source"))
    both = both.unionByName(own.select("query", "chunk", F.lit(1).alias("_part"), F.col("place").alias("_at"), F.lit("route").alias("source")))
    return both.select("query", "chunk", (F.row_number().over(Window.partitionBy("query").orderBy("_part", "_at")) - 1).alias("rank"), "source")
