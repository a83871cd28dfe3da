import pytest
from pyspark.sql import functions as F

from evidex.operators import answers, blocks, company


def test_context_runs_on_and_back():
    rows = [
        {"text": "合并利润表\n| 项目 | 本期 |\n| --- | --- |\n| 营业收入 | 1 |", "page": 1, "section_path": "A"},
        {"text": "单位：万元\n| 项目 | 本期 |\n| 研发费用 | 2 |", "page": 2, "section_path": "A"},
        {"text": "这是一段正文。", "page": 2, "section_path": "A"},
        {"text": "| 项目 | 本期 |\n| --- | --- |\n| 研发费用 | 2 |", "page": 3, "section_path": "A"},
        {"text": "母公司利润表\n| 项目 | 本期 |\n| --- | --- |\n| 营业收入 | 1 |", "page": 3, "section_path": "A"},
    ]
    out = blocks.annotate(rows, "2024年度")
    assert [r["table_id"] for r in out] == ["table-0", "table-0", "", "table-1", "table-2"]
    assert out[0]["unit"] == out[1]["unit"] == "万元" and out[1]["table_name"] == "合并利润表"
    assert [r["statement_scope"] for r in out] == ["consolidated", "consolidated", "unknown", "unknown", "parent"]
    assert out[0]["report_period"] == "2024年度" and not out[2]["is_table"]


def test_chunks_of_blocks(spark):
    rows = [(1, 0, 1, "A > B", "x" * 10, ""), (1, 1, 2, "A > C", "y" * 10, ""), (1, 2, 3, "D", "z" * 100, "")]
    df = spark.createDataFrame(rows, "doc long, block_no int, page int, section_path string, text string, doc_period string")
    got = blocks.flat_chunks(blocks.annotated(df), 40, 5).orderBy("chunk_index").collect()
    assert (got[0]["text"], got[0]["section_path"], got[0]["page_start"], got[0]["page_end"]) == ("x" * 10 + "\n\n" + "y" * 10, "A", 1, 2)
    assert [len(r["text"]) for r in got[1:]] == [40, 40, 30]
    pc = blocks.parent_child(blocks.annotated(df), 60, 30, 0).collect()
    assert {r["kind"] for r in pc} == {"parent", "child"} and max(len(r["text"]) for r in pc if r["kind"] == "child") <= 30


def test_companies(spark):
    assert ("alias", "格力电器") in company.clues_of("格力电器2023年营业收入是多少")
    assert ("code", "600519") in company.clues_of("600519的净利润") and company.clues_of("营业收入是多少") == []
    assert ("name", "浙江某某股份有限公司") in company.clues_of("请问浙江某某股份有限公司2024年净利润")
    known = spark.createDataFrame([("甲乙股份",), ("甲乙丙",), ("ABC Ltd",)], "company string")
    asked = spark.createDataFrame([("甲乙股份",), ("甲乙",), ("abc",), ("zz",)], "asked string")
    got = {r["asked"]: (r["company"], len(r["candidates"])) for r in company.resolved(asked, known).collect()}
    assert got == {"甲乙股份": ("甲乙股份", 1), "甲乙": ("", 2), "abc": ("ABC Ltd", 1), "zz": ("", 0)}
    rec = spark.createDataFrame([("a", "2024年", 1), ("a", "2024年度", 2), ("b", "2024", 3)], "entity string, report_period string, v int")
    assert sorted(r["v"] for r in company.first_period(rec, "2024年报").collect()) == [2, 3]
    assert company.selection([" a", "b"], ["total_assets", "revenue"]) == (["a", "b"], ["revenue", "total_assets"])
    for bad in (["a"], ["a", "a"], ["a", ""], ["a", "b", "c", "d"]):
        with pytest.raises(ValueError):
            company.selection(bad)
    q = spark.createDataFrame([("2024年半年度和2023年对比2024年上半年",)], "q string")
    assert q.select(company.question_periods(F.col("q")).alias("p")).first()["p"] == ["2024年上半年", "2023年"]


def test_queries_and_evidence(spark):
    got = answers.queries_of("2024年营业收入和净利润下降原因", "改写")
    assert got[0] == "2024年营业收入和净利润下降原因" and got[1] == "改写" and any("指标：营业收入" in g for g in got) and any("主要系" in g for g in got) and len(got) <= 8
    ranked = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], "query int, chunk string, rank int")
    cand = spark.createDataFrame([(1, "z", 0, False), (1, "y", 1, True), (1, "b", 2, True)], "query int, chunk string, rank int, certain boolean")
    assert [r["chunk"] for r in answers.protected(ranked, cand, 2).orderBy("rank").collect()] == ["y", "a"]
    hits = spark.createDataFrame([(1, 1, "second", 7, None), (1, 0, "first", 3, "元")], "query int, rank int, text string, page int, unit string")
    assert answers.context_blocks(hits).first()["context"] == "[1] page=3；unit=元\n内容：first\n\n[2] page=7\n内容：second"


def test_answer_rules(spark):
    df = spark.createDataFrame([("营业收入和净利润多少？", "营业收入为5亿元。", "营业收入4亿元，净利润1亿元")], "q string, a string, e string")
    assert df.select(answers.answer_reasons("q", "a", "e").alias("r")).first()["r"] == ["unsupported: 5亿元", "missing: net_profit"]
    said = spark.createDataFrame([("该计划不构成业绩承诺。",), ("是否构成业绩承诺？",), ("该目标构成业绩承诺。",)], "t string")
    assert [r["p"] for r in said.select(answers.commitment_polarity("t").alias("p")).collect()] == [["negative"], [], ["positive"]]
    cite = spark.createDataFrame([("收入4亿元[2]。费用2亿元[2]。", ["收入4亿元", "费用2亿元"])], "a string, p array<string>")
    assert cite.select(answers.relocated("a", "p").alias("x")).first()["x"] == "收入4亿元[1]。费用2亿元[2]。"
    q = spark.createDataFrame([("2024年净利润是多少", []), ("你好", []), ("公司的上市时间？", []), ("公司的上市时间？", [("user", "贵州茅台酒股份有限公司")]), ("广道的上市时间", [])], "q string, h array<struct<role: string, text: string>>")
    rows = q.select(answers.obvious_question(F.col("q")).alias("o"), answers.needs_company(F.col("q"), F.col("h")).alias("n")).collect()
    assert [r["o"] for r in rows] == [True, False, False, False, False] and [r["n"] for r in rows] == [False, False, True, False, False]
    rev = spark.createDataFrame([("revenue", "主营业务收入1"), ("revenue", "营业收入1"), ("eps", "x")], "m string, t string")
    assert [r["s"] for r in rev.select(answers.strict_revenue(F.col("m"), F.col("t")).alias("s")).collect()] == [False, True, True]
