import re
from decimal import Decimal

from pyspark.sql import functions as F

from evidex.functions import text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    def plain(t):
        out = []
        for seg in re.findall("[一-鿿]+|[0-9a-z]+", t.lower()):
            out += [seg[i : i + 2] for i in range(len(seg) - 1)] + [seg] if re.match("[一-鿿]{2}", seg) else [seg]
        return [t for t in out if len(t) > 1 and t not in text.STOP_WORDS]

    for t in ("裕太微2025年上半年营业收入是多少", "Revenue 2024 of A1, b", "公司的营业收入", "", "a 1 é 的"):
        assert one(spark, text.tokens, t) == plain(t), t


def test_redaction_in_order(spark):
    cases = {
        "call 13812345678 now": "call [手机号已隐藏] now",
        "id 11010119900307123X.": "id [身份证号已隐藏].",
        "id 110101199003071234": "id [身份证号已隐藏]",
        "card 6222021234567890": "card [银行卡号已隐藏]",
        "mail a.b+c@d-e.co.uk!": "mail [邮箱已隐藏]!",
        "key sk_abcdefghijklmnop1 end": "key [密钥已隐藏] end",
        "12813812345678 and 1281234567 stay": "12813812345678 and 1281234567 stay",
        "sk_short stays": "sk_short stays",
    }
    for raw, want in cases.items():
        assert one(spark, text.redacted, raw) == want


def test_numbers_units_and_decimals(spark):
    for raw, want in {"1,234.50": "1234.5", "(1,000)": "-1000", " -3 ": "-3", "abc": None, "": None}.items():
        got = one(spark, text.number, raw)
        assert got == (None if want is None else Decimal(want))
    row = spark.sql("SELECT CAST('1.2' AS DECIMAL(20,6)) v").select(text.canonical(F.col("v"), F.lit("亿元")).alias("y")).first()
    assert row["y"] == Decimal("120000000")
    for raw, want in {"12.3400": "12.34", "-0.00": "0", "100": "100", "0.5": "0.5"}.items():
        assert one(spark, lambda c: text.decimal_text(c.cast("decimal(10,4)")), raw) == want
    assert one(spark, lambda c: text.half_up(c.cast("decimal(20,6)")), "2.675") == Decimal("2.68")


def test_periods(spark):
    for raw in ("2024", "2024年", "2024 年度", "2024年报"):
        assert one(spark, text.annual_period, raw) == "2024年度"
    assert one(spark, text.annual_period, "2024年半年度") is None
    assert one(spark, text.previous_period, "2025年半年度") == "2024年半年度" and one(spark, text.previous_period, "x") is None
    same = spark.createDataFrame([("2024年度", "2024年"), ("2025年半年度", "2025年上半年"), ("2024年一季度", "2024年第一季度"), ("2024年度", "2023年度"), (None, "2024年")], "a string, b string")
    assert [r["y"] for r in same.select(text.same_period(F.col("a"), F.col("b")).alias("y")).collect()] == [True, True, True, False, False]


def test_layout(spark):
    assert [one(spark, text.page_number, t) for t in ("12", "第 3 页", "3/10", "第1页共9页", "12345", "x")] == [True, True, True, True, False, False]
    assert one(spark, text.checkboxes, "√适用 □不适用") == "适用：是" and one(spark, text.checkboxes, "□适用 √不适用") == "适用：否"
    levels = {"# Title": 1, "## Part": 2, "第一章 总则": 1, "第二节 公司": 2, "第三条 规定": 3, "一、概述": 2, "1. Item": 3, "1.2 Sub": 4, "2024": 0, "plain text": 0, "1. " + "x" * 60: 0}
    for line, level in levels.items():
        assert one(spark, text.heading, line) == level, line
    assert one(spark, text.header_line, "某某股份有限公司2025年半年度报告") and not one(spark, text.header_line, "营业收入 100")
    assert one(spark, text.masked, "abcdefghijkl") == "abcd***ijkl" and one(spark, text.masked, "abc") == "***"
