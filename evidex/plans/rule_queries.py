"""Rules on texts, numbers and periods, each over all customers with inputs by the customer's key."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import filters, text
from ..operators import answers, blocks, chunking, company, facts, gates, retrieval, route, verify
from ..sources import readers, sinks
from .variants import rule


def column(name: str, inputs: dict, expected, make, kinds: dict | None = None) -> None:
    """A rule that gives one column, ``out``."""
    rule(name, inputs, {"out": expected}, lambda df: df.withColumn("out", make(*[F.col(c) for c in inputs])), kinds)


def joined(items: Column) -> Column:
    return F.array_join(items, "|", "-")


# parsing
column("page_number_lines", {"t": ["⟨n⟩", "第 ⟨n⟩ 页", "3/⟨n⟩", "第3页 共9页", "⟨y⟩年", "第三页", "12345", "", "1 / 2 / 3"]}, [True, True, True, True, False, False, False, False, False], text.page_number)
column("checkbox_words", {"t": ["√适用 □不适用", "□ 适用 ☑ 不适用", "⟨w⟩：√是 □否", "□是 √否", "适用⟨n⟩"]}, ["适用：是", "适用：否", "⟨w⟩：是", "否", "适用⟨n⟩"], text.checkboxes)
column(
    "heading_levels",
    {"t": ["# 标题", "### 三级", "####### x", "第一章 总则", "第二节 财务", "第十条 其他", "一、概况", "1. 收入", "1.2 成本", "12.5%", "⟨y⟩", "正文一句。", "1. " + "长" * 60, "#无空格"]},
    [1, 3, 0, 1, 2, 3, 2, 3, 4, 0, 0, 0, 0, 0],
    text.heading,
)
column("pages_joined", {"p": [["⟨w⟩", "b⟨n⟩"], ["a⟨y⟩", " ", "⟨w⟩"], ["", ""], ["⟨n⟩"]]}, ["⟨w⟩\n\nb⟨n⟩", "a⟨y⟩\n\n⟨w⟩", "", "⟨n⟩"], readers.pages_text)
column(
    "table_to_markdown",
    {"r": [[["a", "⟨y⟩"], ["⟨w⟩", "⟨n⟩"]], [["a", "⟨y⟩"], ["⟨n⟩"]], [["⟨w⟩", "b"]], [["⟨n⟩"], ["b"]], [["a", "⟨w⟩"], [" ⟨n⟩\n2 ", None]]]},
    ["| a | ⟨y⟩ |\n| --- | --- |\n| ⟨w⟩ | ⟨n⟩ |", "| a | ⟨y⟩ |\n| --- | --- |\n| ⟨n⟩ |  |", None, None, "| a | ⟨w⟩ |\n| --- | --- |\n| ⟨n⟩ 2 |  |"],
    readers.table_markdown,
    {"r": "array<array<string>>"},
)
column("file_extensions", {"p": ["/⟨w⟩/⟨n⟩.PDF", "⟨y⟩.tar.gz", "⟨w⟩", "a.b/c", ".md"]}, ["pdf", "gz", "", "", "md"], readers.extension)
column(
    "ocr_routes",
    {"t": ["营业收入 ⟨n⟩", "营业收入 ⟨n⟩", "....,,,,;;;;", "", "text"], "s": [[0.9, 0.8], [0.5, 0.4], [0.9], [0.9], []]},
    ["local", "external", "external", "external", "external"],
    readers.ocr_route,
    {"s": "array<double>"},
)
# stores
column("flags", {"v": ["true", " YES ", "1", "⟨w⟩", "0", None, "True "]}, [True, True, True, False, False, False, True], filters.flag)
column("masked_keys", {"v": ["abcd⟨n⟩⟨w⟩ijkl", "short", "⟨n⟩⟨n⟩", "⟨y⟩56⟨p⟩", None]}, ["abcd***ijkl", "*****", "******", "⟨y⟩***⟨p⟩", None], text.masked)
column(
    "point_ids",
    {"kb": ["default", "fin", "default"], "c": ["d1-0", "d1-0", "d2-17"]},
    ["f27cb3c9-64fd-5f67-8736-177b0e00059f", "0fdfb357-b181-5628-b793-cbc4ea0249b5", "65211a64-ec66-5291-80ae-1e565640fe2c"],
    sinks.point_id,
)
column(
    "signatures",
    {"m": ["", "what do ya want for nothing?"]},
    ["923598ca6d64af2a5dba79dcd021a8a0fe5c5f557519adaaf0ad532d4506dd30", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"],
    lambda m: text.hmac_sha256(m, b"Jefe"),
)
column("document_ids", {"m": ["a", "abc"]}, ["86f7e437faa5a7fce15d1ddcb9eaeaea377667b8", "a9993e364706816aba3e25717850c26c9cd0d89d"], lambda m: F.sha1(m.cast("binary")))
# predicates
column("page_headers", {"t": ["⟨w⟩公司⟨y⟩年年度报告", "⟨w⟩公司⟨y⟩年半年度报告全文", "⟨w⟩公司 ⟨y⟩年报告摘要", "⟨w⟩公司⟨y⟩年年度报告，正文很多", "⟨y⟩年年度报告", "甲" * 41 + "⟨y⟩年报告"]}, [True, True, True, False, False, False], text.header_line)
column("figures_in_text", {"t": ["营业收入 1,200", "第 12 页 ⟨y⟩", "600519", "公司 600519", "金额 1.5", "⟨y⟩", "共 7 项", None]}, [True, False, False, True, True, False, False, False], route.has_number)
column(
    "sources_by_name",
    {"p": ["/data/⟨w⟩公司.PDF", "C:\\kb\\Report.md", "noext", ".pdf", "a/b/", None]},
    ["⟨v⟩公司.pdf|⟨v⟩公司", "report.md|report", "noext", ".pdf", "b", ""],
    lambda p: joined(gates.source_keys(p)),
)
# periods, units, numbers
column("annual_periods", {"t": ["⟨y⟩", "⟨y⟩年", "⟨y⟩年度", " ⟨y⟩ 年报", "⟨y⟩年半年度", "24年", None]}, ["⟨y⟩年度", "⟨y⟩年度", "⟨y⟩年度", "⟨y⟩年度", None, None, None], text.annual_period)
column("previous_periods", {"t": ["⟨y⟩年度", "⟨y⟩年半年度", "2000年", "本期"]}, ["⟨p⟩年度", "⟨p⟩年半年度", "1999年", None], text.previous_period)
column("normal_periods", {"t": ["⟨y⟩年度", "⟨y⟩年半年度", "⟨y⟩ 年一季度", "⟨y⟩年第三季度", "⟨y⟩", "⟨y⟩年报", "⟨y⟩年上半年"]}, ["⟨y⟩年", "⟨y⟩年上半年", "⟨y⟩年第一季度", "⟨y⟩年第三季度", "⟨y⟩年", "⟨y⟩年", "⟨y⟩年上半年"], text.normal_period)
column("period_matches", {"a": ["⟨y⟩年度", "⟨y⟩年", "⟨y⟩年半年度", "⟨y⟩年", "⟨p⟩年"], "b": ["⟨y⟩年", "⟨y⟩年上半年", "⟨y⟩年上半年", "⟨y⟩", "⟨y⟩年"]}, [True, False, True, True, False], text.same_period)
column("lenient_periods", {"a": ["⟨y⟩年", "⟨y⟩年第一季度", "⟨p⟩年"], "b": ["⟨y⟩年上半年", "⟨y⟩年上半年", "⟨y⟩年上半年"]}, [True, False, False], lambda a, b: text.same_period(a, b, True))
column("scope_conflicts", {"a": ["parent", "unknown", "parent", "", "consolidated"], "b": ["parent", "parent", "consolidated", "parent", "subsidiary"]}, [False, False, True, False, True], verify.scopes_conflict)
column("unit_families", {"u": ["元", "万美元", "亿港元", "%", "", "百万元"]}, ["rmb", "usd", "hkd", "percent", "rmb", "rmb"], text.unit_family)
column("unit_matches", {"a": ["元", "元", "", "", "%", "万元"], "b": ["亿元", "美元", "", "元", "％", "%"]}, [True, False, True, False, True, False], verify.compatible_units)
column("cell_numbers", {"t": ["1,234.50", "(1,000)", "-5", "n/a", "", "3 000"]}, [D("1234.5"), D("-1000"), D("-5"), None, None, D("3000")], text.number)
column("decimal_texts", {"v": [D("1.500000"), D("0.000000"), D("100.000000"), D("-0.250000")]}, ["1.5", "0", "100", "-0.25"], text.decimal_text, {"v": "decimal(20,6)"})
column("question_periods", {"t": ["⟨y⟩年和⟨p⟩年度营业收入", "⟨y⟩年半年度与⟨y⟩年上半年", "没有年份", "⟨y⟩年第一季度"]}, ["⟨y⟩年|⟨p⟩年", "⟨y⟩年上半年", "", "⟨y⟩年第一季度"], lambda t: joined(company.question_periods(t)))
column("route_periods", {"t": ["⟨y⟩年和⟨p⟩年营业收入", "2025 年半年度净利润", "⟨y⟩年的天气", "营业收入"]}, ["⟨y⟩年度|⟨p⟩年度", "2025年半年度", "", ""], lambda t: joined(route.periods_asked(t)))
# companies
column(
    "company_clues",
    {"t": ["请问⟨w⟩科技股份有限公司⟨y⟩年营业收入", "*ST 甲乙⟨y⟩年净利润", "600519的营业收入", "甲乙⟨y⟩年营业收入是多少", "天气怎么样"]},
    ["name:⟨v⟩科技股份有限公司|alias:⟨v⟩科技", "st:st甲乙|alias:甲乙", "code:600519|alias:600519", "alias:甲乙", ""],
    lambda t: joined(F.transform(company.clues(t), lambda c: F.concat_ws(":", c["kind"], c["value"]))),
)
column(
    "company_markers",
    {"t": ["⟨w⟩科技股份有限公司⟨y⟩年年度报告", "甲乙⟨y⟩年年度报告", None], "n": [None, None, "甲乙股份有限公司"], "c": ["600519", None, None]},
    ["alias:⟨v⟩科技|code:600519|name:⟨v⟩科技股份有限公司", "alias:甲乙", "alias:甲乙|name:甲乙股份有限公司"],
    lambda t, n, c: joined(F.transform(company.markers(t, n, c), lambda m: F.concat_ws(":", m["kind"], m["value"]))),
    {"t": "string", "n": "string", "c": "string"},
)
# tables and facts
column("table_titles", {"t": ["⟨w⟩合并利润表\n单位：元", "本公司利润表，见附注", "母公司 资产负债表", "正文", "表" * 101 + "利润表"]}, ["合并利润表", "", "母公司资产负债表", "", ""], lambda t: facts.table_context(t)["table_name"])
column("table_units", {"t": ["单位：万元", "金额单位：人民币元", "单位：元\n单位：万元", "收入 ⟨n⟩ 万元", "（金额：百万元）", "币种及单位：亿元"]}, ["万元", "元", "", "", "百万元", "亿元"], lambda t: facts.table_context(t)["unit"])
column(
    "table_periods",
    {"t": ["⟨y⟩年年度报告", "⟨y⟩年半年度报告", "报告期：⟨y⟩年1月1日至⟨y⟩年6月30日", "截至⟨y⟩年6月30日", "本期 ⟨y⟩年1月-6月", "⟨p⟩年", "正文"]},
    ["⟨y⟩年度", "⟨y⟩年半年度", "⟨y⟩年1月1日至⟨y⟩年6月30日", "⟨y⟩年6月30日", "⟨y⟩年1月-6月", "⟨p⟩年", ""],
    lambda t: facts.table_context(t)["report_period"],
)
column("table_scopes", {"t": ["⟨w⟩合并利润表", "母公司资产负债表", "合并报表\n母公司报表", "⟨w⟩合并日", "报表口径：子公司"]}, ["consolidated", "parent", "unknown", "unknown", "subsidiary"], lambda t: facts.table_context(t)["statement_scope"])
column("markdown_tables", {"t": ["| ⟨w⟩ | ⟨n⟩ |\n| --- | --- |", "| ⟨w⟩ | ⟨n⟩ |", "| a |\n| b |\n| c |", "| a |\n| b |", "text"]}, [True, False, True, False, False], lambda t: facts.table_context(t)["is_table"])
column("document_periods", {"t": ["⟨w⟩公司⟨y⟩年年度报告", "⟨w⟩公司", "⟨w⟩公司", ""], "p": [["⟨p⟩年报"], ["目录\n⟨p⟩年半年度报告", "x"], ["正文提到2022年度"], []]}, ["⟨y⟩年度", "⟨p⟩年半年度", "", ""], facts.document_periods, {"p": "array<string>"})
column("common_paths", {"a": ["⟨w⟩ > 二 > 三", "⟨n⟩", "一 > 二", ""], "b": ["⟨w⟩ > 二 > 四", "⟨n⟩ > ⟨w⟩", "三", "一"]}, ["⟨w⟩ > 二", "⟨n⟩", "", ""], chunking.common_path)
column("merge_guards", {"a": ["t⟨n⟩", "t⟨n⟩", "", None], "b": ["t⟨n⟩", "t2", "t2", "t⟨n⟩"]}, [True, False, True, True], chunking.mergeable)
rule("page_spans", {"a": [3, None, 5, None], "b": [7, 4, None, None]}, {"first": [3, 4, 5, None], "last": [7, 4, 5, None]}, lambda df: df.withColumn("first", chunking.page_span("a", "b")[0]).withColumn("last", chunking.page_span("a", "b")[1]), {"a": "int", "b": "int"})
column("text_units", {"t": ["a\n\n⟨w⟩", "⟨n⟩\n \n\n b ", "\n\n", "one\n⟨y⟩"]}, ["a|⟨w⟩", "⟨n⟩|b", "", "one\n⟨y⟩"], lambda t: joined(chunking.units(t)))
column("table_pieces", {"t": ["| h |\n| - |\n| ⟨n⟩ |\n| 2 |\n| 3 |", "| h |\n| - |"]}, ["| h |\n| - |\n| ⟨n⟩ |#| h |\n| - |\n| 2 |#| h |\n| - |\n| 3 |", "| h |\n| - |"], lambda t: F.array_join(chunking.table_pieces(t, 20), "#"))
column("continuation_blocks", {"t": ["单位：元", "续表\n营业收入 ⟨n⟩ ⟨n⟩", "续表", "营业收入 ⟨n⟩ ⟨y⟩", "甲\t1\t2\n乙\t3\t4", "这是正文。", "合并利润表", ""]}, [True, True, False, True, True, False, False, False], blocks.continuation)
# answers
column(
    "cause_terms",
    {"t": ["主要系⟨w⟩销量上升所致。由于⟨y⟩年汇率变动，成本下降", "变动原因为：⟨w⟩原材料涨价", "受⟨w⟩市场需求影响，收入下降", "原因是详见正文", "没有说明"]},
    ["⟨w⟩销量上升|⟨y⟩年汇率变动", "⟨w⟩原材料涨价", "⟨w⟩市场需求", "", ""],
    lambda t: joined(verify.causes(t)),
)
column("commitments", {"t": ["⟨w⟩事项不构成业绩承诺。", "⟨w⟩公司属于业绩承诺方", "是否构成承诺", "没有", "不构成承诺。视为盈利承诺"]}, ["negative", "positive", "", "", "negative|positive"], lambda t: joined(answers.commitment_polarity(t)))
column("categories", {"t": ["FAQ", "转人工", "闲聊", "知识库", "⟨v⟩", None, "out of scope", "报障"]}, ["faq", "human_request", "smalltalk", "kb_question", "kb_question", "kb_question", "out_of_scope", "ticket_intent"], verify.category)
column("rewrites", {"q": ["原问题⟨w⟩"] * 5, "r": ["改写⟨n⟩", "", "两\n行", "长" * 121, None]}, ["改写⟨n⟩", "原问题⟨w⟩", "原问题⟨w⟩", "原问题⟨w⟩", "原问题⟨w⟩"], verify.rewritten, {"r": "string"})
column("judge_marks", {"t": ["8,9", "faithfulness 7, relevance 5", "7", "⟨w⟩", None]}, [8, 5, 7, 0, 0], verify.faithfulness, {"t": "string"})
rule(
    "citation_numbers",
    {"t": ["⟨w⟩[2]乙[1]⟨n⟩[2]", "⟨w⟩[7]", "没有", "[3][3][1]"]},
    {"out": ["⟨w⟩[1]乙[2]⟨n⟩[1]", "⟨w⟩7", "没有", "[1][1][2]"], "used": ["2|1", "", "", "3|1"]},
    lambda df: df.withColumn("out", verify.renumbered(F.col("t"), F.lit(3))[0]).withColumn("used", joined(F.transform(verify.renumbered(F.col("t"), F.lit(3))[1], lambda x: x.cast("string")))),
)
column("citations_moved", {"a": ["收入为⟨n⟩.5万元[2]。", "收入为⟨n⟩.5万元[1]。", "收入为9⟨n⟩.5万元[2]。", "没有数字[2]。"], "p": [["收入⟨n⟩.5万元", "成本7⟨n⟩.5万元"]] * 4}, ["收入为⟨n⟩.5万元[1]。", "收入为⟨n⟩.5万元[1]。", "收入为9⟨n⟩.5万元[2]。", "没有数字[2]。"], answers.relocated)
column("clear_questions", {"q": ["⟨w⟩公司年报营业收入是多少", "你好", "转人工", "净利润多少", "", "介绍年报"]}, [True, False, False, True, False, False], answers.obvious_question)
column(
    "company_needed",
    {"q": ["注册资本是多少", "⟨w⟩股份有限公司的注册资本", "注册资本是多少", "这家公司的董事长是谁", "天气怎么样", "600519的上市日期"], "h": ["你好", "", "甲乙股份有限公司", "谢谢", "", ""]},
    [True, False, False, True, False, False],
    lambda q, h: answers.needs_company(q, F.array(F.struct(F.lit("user").alias("role"), h.alias("text")), F.struct(F.lit("assistant").alias("role"), F.lit("丙丁有限公司").alias("text")))),
)
column("strict_revenue", {"m": ["revenue", "revenue", "net_profit", "revenue"], "t": ["主营业务收入 ⟨n⟩", "营业收入 ⟨n⟩", "主营业务收入", "主营业务收入 ⟨n⟩ 营业收入 9⟨n⟩"]}, [False, True, True, True], answers.strict_revenue)
column("metric_equivalence", {"a": ["revenue", "revenue", "eps", "revenue"], "b": ["total_revenue", "total_revenue", "eps", "eps"], "t": ["营业总收入 ⟨n⟩", "营业总收入 ⟨n⟩ 营业收入 4⟨n⟩", "", ""]}, [True, False, True, False], answers.same_metric)
column("reliable_evidence", {"s": [True, True, None, False], "p": [True, False, True, True], "m": [True, True, True, None]}, [True, False, False, False], answers.reliable, {"s": "boolean", "p": "boolean", "m": "boolean"})
column(
    "answer_faults",
    {"q": ["营业收入是多少", "营业收入和研发费用是多少", "营业收入变动原因", "营业收入是多少"], "a": ["营业收入为⟨n⟩.5万元", "营业收入为⟨n⟩.5万元", "营业收入为⟨n⟩.5万元", "未检索到"], "e": ["营业收入9⟨n⟩.5万元", "营业收入⟨n⟩.5万元 研发费用1⟨n⟩.5万元", "营业收入⟨n⟩.5万元，主要系销量", "营业收入⟨n⟩.5万元"]},
    ["unsupported: ⟨n⟩.5万元", "missing: rd_expense", "missing: cause", "missing: revenue|wrong refusal"],
    lambda q, a, e: joined(answers.answer_reasons(q, a, e)),
)
column("masked_numbers", {"t": ["收入⟨n⟩.5万元，成本3万元", "无"], "s": [[[2, 9]], []]}, ["收入（未核验），成本3万元", "无"], lambda t, s: verify.masked_answer(t, F.transform(s, lambda x: F.struct(x[0].alias("start"), x[1].alias("end")))), {"s": "array<array<int>>"})
column("search_strings", {"q": ["⟨w⟩营业收入和研发费用是多少", "⟨w⟩研发费用变动原因", "天气", " "], "r": ["", "改写", None, ""], "a": [0, 0, 0, 0]}, ["⟨w⟩营业收入和研发费用是多少|⟨w⟩营业收入和研发费用是多少 指标：营业收入|⟨w⟩营业收入和研发费用是多少 指标：研发费用|⟨w⟩营业收入和研发费用是多少 合并财务报表 合并口径", "⟨w⟩研发费用变动原因|改写|⟨w⟩研发费用变动原因 主要系 原因 所致 变动原因|⟨w⟩研发费用变动原因 合并财务报表 合并口径", "天气", ""], lambda q, r, a: joined(answers.search_strings(q, r, a)), {"r": "string", "a": "int"})
column("number_matches", {"e": ["⟨n⟩.5万元", "⟨n⟩5000元", "1.2亿元", "20%", "销量上升", "", "12345元"], "a": ["收入⟨n⟩5000元", "收入⟨n⟩.5万元", "收入1.3亿元", "增长20.0%", "因为 销量 上升", "x", "约1.23万元"]}, [True, True, False, True, True, True, True], gates.keyword_match)
column("nfkc_texts", {"t": ["Ａ⟨n⟩", "①", "ﬁ", None]}, ["A⟨n⟩", "1", "fi", None], verify.nfkc, {"t": "string"})
# questions
rule(
    "question_intents",
    {"t": ["母公司营业收入和研发费用是多少", "⟨y⟩年净利润变动原因", "管理层讨论与分析中的经营情况", "受疫情影响的归母净利润", "天气"]},
    {"groups": ["revenue|rd_expense", "", "", "listed_net_profit", ""], "scope": ["parent", "", "", "", ""], "is_cause": [False, True, False, True, False], "is_financial": [True, True, False, True, False], "is_numeric": [True, False, False, False, False], "sections": ["", "", "经营情况|管理层讨论与分析", "", ""]},
    lambda df: df.withColumn("p", retrieval.profile(F.col("t"))).select("k", joined("p.groups").alias("groups"), "p.scope", "p.is_cause", "p.is_financial", "p.is_numeric", joined("p.sections").alias("sections")),
)
rule(
    "merged_intents",
    {"a": ["母公司研发费用为什么增长", "营业收入", "⟨w⟩归母净利润多少"], "b": ["合并营业收入 利润表", "原因", "天气"]},
    {"groups": ["revenue|rd_expense", "revenue", "listed_net_profit"], "scope": ["parent", "", ""], "is_cause": [True, True, False], "is_numeric": [False, False, True], "sections": ["利润表", "", ""]},
    lambda df: df.withColumn("p", retrieval.merged_profile(F.array(retrieval.profile(F.col("a")), retrieval.profile(F.col("b"))), F.col("a"))).select("k", joined("p.groups").alias("groups"), "p.scope", "p.is_cause", "p.is_numeric", joined("p.sections").alias("sections")),
)
_HIT = {"q": ["营业收入是多少", "营业收入是多少", "母公司营业收入是多少", "营业收入原因", "营业收入原因", "利润表营业收入多少"], "t": ["x", "营业收入 ⟨n⟩", "营业收入 ⟨n⟩", "主要系⟨w⟩销量", "营业收入 ⟨n⟩", "⟨w⟩"], "m": [["revenue"], [], [], [], [], []], "s": ["consolidated", "parent", "parent", None, None, None], "tab": [True, True, True, False, True, True], "path": ["", "", "", "", "", "合并利润表"]}
_KINDS = {"m": "array<string>", "s": "string", "tab": "boolean"}
column("rank_rules", _HIT, [0.023, 0.006, 0.013, 0.012, -0.006, 0.008], lambda q, t, m, s, tab, path: retrieval.adjustment(retrieval.profile(q), t, m, s, tab, path), _KINDS)
column("metric_match_kinds", _HIT, ["fact", "header", "header", "", "header", ""], lambda q, t, m, s, tab, path: retrieval.match_kind(retrieval.profile(q), t, F.lit(""), m), _KINDS)
