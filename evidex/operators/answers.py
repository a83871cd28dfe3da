"""Rules around an answer: queries to ask, evidence to show, what is missing, citations, guardrails."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .verify import _METRIC, _WORD, CLAIM_METRICS, claims_of

NAMES = {m: words[0] for m, words in CLAIM_METRICS.items()}
# Words of causes, sections, statement scope, commitments, and of questions for the knowledge base.
REASON = "原因|为什么|为何|主要系|所致"
SECTION = "经营情况概述|经营情况|经营回顾|管理层讨论与分析"
SCOPE = "营业总?收入|净利润|现金流|资产总额|负债总额|利润总额|研发"
MATERIAL = "年报|半年报|季报|报告|公告|招股|财务|营业|净利润|现金流|研发|资产|负债|每股收益|股东|分红|主营"
ASKING = "多少|什么|哪些|如何|怎么|是否|为何|为什么|几|吗|？|\\?"
OTHER = "转人工|人工客服|投诉|工单|报障|你好|您好|谢谢|天气|笑话"
COMMITMENT, NOT, ASKED = "业绩承诺|盈利承诺|承诺", "不构成|并非|不代表|不属于|不是", "是否|是不是|会不会|能否|能不能|算不算"
POSITIVE = "构成|属于|视为|是(?:公司)?(?:对投资者的)?(?:业绩|盈利)?承诺"
METADATA = ("doc_title", "source_type", "page", "page_start", "page_end", "section_path", "table_name", "statement_scope", "report_period", "unit", "is_table", "chunk_id")


def metrics_in(text: str) -> list[str]:
    return list(dict.fromkeys(_WORD[w] for w in _METRIC.findall(text or "")))


def queries_of(question: str, rewritten: str = "", attempt: int = 0, hints: str = "") -> list[str]:
    """The search strings of a question, itself first: its rewrite, each of several metrics, sections, causes, scope, an exact retry."""
    q, metrics = (question or "").strip(), metrics_in(question)
    out = [q, (rewritten or "").strip()]
    if len(metrics) > 1:
        out += [f"{q} 指标：{NAMES[m]}" for m in metrics]
    if metrics and re.search(SECTION, q):
        out.append("经营情况概述 经营情况 " + "/".join(NAMES[m] for m in metrics))
    if re.search(REASON, q):
        out.append(f"{q} 主要系 原因 所致 变动原因")
    if re.search(SCOPE, q) and "母公司" not in q:
        out.append(f"{q} 合并财务报表 合并口径")
    if attempt and hints:
        out.append(f"{q} 精确匹配 {hints}")
    return [x for x in dict.fromkeys(out) if x][:8]


def _queries(questions: pd.Series, rewrites: pd.Series, attempts: pd.Series) -> pd.Series:
    return pd.Series([queries_of(q, r, int(a or 0)) for q, r, a in zip(questions, rewrites, attempts)], dtype=object)


def search_strings(question: Column, rewritten: Column, attempt: Column) -> Column:
    return F.pandas_udf(_queries, "array<string>")(question, rewritten, attempt)


def metadata_line(df: DataFrame, fields=METADATA) -> Column:
    """key=value of the fields that a hit has, in order."""
    have = [f for f in fields if f in df.columns]
    parts = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in have]))
    return F.array_join(parts, "；")


def context_blocks(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """(query, context): numbered blocks of metadata and passage in the order of rank."""
    text = F.col("text") if limit is None else F.substring("text", 1, limit)
    block = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), metadata_line(hits), F.lit("\n内容："), text)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    return hits.groupBy("query").agg(F.array_join(blocks, "\n\n").alias("context"))


def protected(reranked: DataFrame, candidates: DataFrame, top: int) -> DataFrame:
    """The best hits of each query, with its first candidate of certain evidence in front if they lack it.

    ``reranked`` (query, chunk, rank), ``candidates`` (query, chunk, rank, certain).
    """
    keep = reranked.filter(F.col("rank") < top)
    sure = candidates.filter("certain").groupBy("query").agg(F.min_by("chunk", "rank").alias("chunk"))
    extra = sure.join(keep.select("query", "chunk"), ["query", "chunk"], "left_anti").withColumn("rank", F.lit(-1))
    w = Window.partitionBy("query").orderBy("rank")
    return keep.select("query", "chunk", "rank").unionByName(extra).withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < top)


def reliable(subject: Column, period: Column, metric: Column) -> Column:
    """Evidence counts by itself if subject, period and metric all match."""
    return F.coalesce(subject & period & metric, F.lit(False))


def _polarity(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        found = set()
        for s in re.split("[\n。！？；]", t or ""):
            if re.search(COMMITMENT, s):
                if re.search(NOT, s):
                    found.add("negative")
                elif re.search(POSITIVE, s) and not re.search(ASKED, s):
                    found.add("positive")
        out.append(sorted(found))
    return pd.Series(out, dtype=object)


def commitment_polarity(text: Column) -> Column:
    """What sentences say of a commitment; a question says nothing."""
    return F.pandas_udf(_polarity, "array<string>")(text)


def strict_revenue(claim_metric: Column, evidence_text: Column) -> Column:
    """Whether evidence may back a claim of revenue: not if it speaks of revenue of the main business only."""
    bare = F.regexp_replace(F.coalesce(evidence_text, F.lit("")), "主营业务收入", "")
    return (claim_metric != "revenue") | bare.contains("营业收入")


def same_metric(a: Column, b: Column, evidence_text: Column) -> Column:
    """Revenue and total revenue stand for each other unless the evidence states both."""
    pair = a.isin("revenue", "total_revenue") & b.isin("revenue", "total_revenue")
    both = F.coalesce(evidence_text.contains("营业总收入") & F.regexp_replace(evidence_text, "营业总收入", "").contains("营业收入"), F.lit(False))
    return (a == b) | (pair & ~both)


def _reasons(questions: pd.Series, answers: pd.Series, evidence: pd.Series) -> pd.Series:
    out = []
    for q, a, e in zip(questions, answers, evidence):
        q, a, e = q or "", a or "", e or ""
        known = {(c["canonical_value"], c["is_percent"]) for c in claims_of(e)}
        found = [f"unsupported: {c['raw']}" for c in claims_of(a) if (c["canonical_value"], c["is_percent"]) not in known]
        found += [f"missing: {m}" for m in metrics_in(q) if m not in metrics_in(a) and m in metrics_in(e)]
        if re.search(REASON, q) and re.search("主要系|由于|原因", e) and not re.search("系|由于|原因|因", a):
            found.append("missing: cause")
        if re.search("未检索到|无法回答", a) and set(metrics_in(q)) & set(metrics_in(e)):
            found.append("wrong refusal")
        out.append(found)
    return pd.Series(out, dtype=object)


def answer_reasons(question: Column, answer: Column, evidence: Column) -> Column:
    """Why an answer fails, by rules: unsupported numbers, missing metrics or causes, a refusal in spite of evidence."""
    return F.pandas_udf(_reasons, "array<string>")(question, answer, evidence)


def _relocated(answers: pd.Series, passages: pd.Series) -> pd.Series:
    out = []
    for answer, texts in zip(answers, passages):
        values = [{(c["canonical_value"], c["is_percent"]) for c in claims_of(t)} for t in (texts if texts is not None else [])]
        parts = re.split("(?<=[。！？；\n])", answer or "")
        for i, s in enumerate(parts):
            want = {(c["canonical_value"], c["is_percent"]) for c in claims_of(s)}
            marks = [int(m) for m in re.findall(r"\[(\d+)\]", s)]
            good = [k + 1 for k, v in enumerate(values) if want and want <= v]
            if len(marks) == 1 and len(good) == 1 and marks[0] not in good:
                parts[i] = s.replace(f"[{marks[0]}]", f"[{good[0]}]")
        out.append("".join(parts))
    return pd.Series(out)


def relocated(answer: Column, passages: Column) -> Column:
    """An answer whose sentences cite the one passage that holds all their numbers, where the cited one does not."""
    return F.pandas_udf(_relocated, "string")(answer, passages)


def obvious_question(question: Column) -> Column:
    """Whether a question surely goes to the knowledge base."""
    q = F.trim(F.coalesce(question, F.lit("")))
    return (q != "") & q.rlike(MATERIAL) & q.rlike(ASKING) & ~q.rlike(OTHER)


def needs_company(question: Column, history: Column) -> Column:
    """Whether to ask for the company: a fact of a company is asked, and neither the question nor the user's last eight turns name one."""
    named = "股份有限公司|有限公司|\\*?ST|(?<![0-9])(?:00|30|60|68)[0-9]{4}(?![0-9])"
    said = F.transform(F.filter(history, lambda h: h["role"] == "user"), lambda h: h["text"])
    n = F.size(said)
    recent = F.slice(said, F.greatest(n - 7, F.lit(1)), F.lit(8))
    fact = question.rlike("上市时间|上市日期|股票代码|注册资本|法定代表人|实际控制人|注册地址|董事长")
    subject = question.rlike(named) | question.rlike("^(?!(?:这家|该|本|贵)?公司)[一-鿿]{2,8}的?(?:上市时间|上市日期|股票代码|注册资本|法定代表人|实际控制人|注册地址|董事长)")
    return fact & ~subject & ~F.exists(recent, lambda t: F.coalesce(t.rlike(named), F.lit(False)))
