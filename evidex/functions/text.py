"""Text functions as Columns: tokens, redaction, numbers, units, periods, layout."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOP_WORDS = "的 了 和 与 或 在 是 有 为 对 把 被 这 那 个 等 及 并 而 从 到 于 之 其 公司 我们 你们 他们 以及 关于 进行 一个 如何".split()
HAN = "[\\u4e00-\\u9fff]"
# Fixed value: what \s stands for.
BLANKS = " \t\n\x0b\f\r"


def tokens(text: Column) -> Column:
    """Search terms in order, repeats included: runs of a-z and 0-9; each two neighbours of a Han run, then the run."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def parts(run):
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike(f"^{HAN}"), F.concat(pairs, F.array(run))).otherwise(F.array(run))

    runs = F.regexp_extract_all(low, F.lit(f"({HAN}{{2,}}|[0-9a-z]{{2,}})"), 1)
    mixed = F.filter(F.flatten(F.transform(runs, parts)), lambda t: ~t.isin(STOP_WORDS))
    # no stop word is without Han characters, so other texts need no look at each term
    return F.when(low.rlike(HAN), mixed).otherwise(F.regexp_extract_all(low, F.lit("([0-9a-z]{2,})"), 1))


def terms_of(text: str) -> list[str]:
    """The search terms of one text as :func:`tokens` gives them, for tasks that hold texts."""
    out = []
    for run in re.findall(f"{HAN}{{2,}}|[0-9a-z]{{2,}}", text.lower()):
        out += [run[i : i + 2] for i in range(len(run) - 1)] if run[0] > "z" else []
        out.append(run)
    return [t for t in out if t not in STOP_WORDS]


# What is hidden, in this order, and what stands in its place.
REDACTIONS = (
    ("(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "[手机号已隐藏]"),
    ("(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])", "[身份证号已隐藏]"),
    ("(?<![0-9])[0-9]{16,19}(?![0-9])", "[银行卡号已隐藏]"),
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[邮箱已隐藏]"),
    ("\\b(?:sk|kb)_[A-Za-z0-9_-]{16,}\\b", "[密钥已隐藏]"),
)


def redacted(text: Column) -> Column:
    for pattern, stand_in in REDACTIONS:
        text = F.regexp_replace(text, pattern, stand_in)
    return text


def masked(text: Column, head: int = 4, tail: int = 4) -> Column:
    """The ends of a secret; all stars if nothing would stay hidden."""
    short = F.length(text) <= head + tail
    return F.when(short, F.repeat(F.lit("*"), F.length(text))).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("***"), F.right(text, F.lit(tail))))


def number(text: Column) -> Column:
    """A decimal from a cell: thousands separators go, parentheses are a minus; null if it is none."""
    bare = F.regexp_replace(text, "[\\s,]", "")
    held = bare.rlike("^\\(.*\\)$")
    value = F.regexp_replace(bare, "[()]", "").try_cast("decimal(30,6)")
    return F.when(held, -value).otherwise(value)


# What one of a unit is in the base unit of its family.
UNIT_SCALE = {
    "": 1, "元": 1, "人民币元": 1, "港元": 1, "美元": 1, "千元": 1000, "万元": 10_000, "万美元": 10_000, "万港元": 10_000, "百万元": 1_000_000,
    "百万美元": 1_000_000, "亿元": 100_000_000, "亿美元": 100_000_000, "亿港元": 100_000_000, "%": 1, "％": 1,
}


def unit_scale(unit: Column) -> Column:
    pairs = [F.lit(x) for k, v in UNIT_SCALE.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.coalesce(unit, F.lit("")))


def unit_family(unit: Column) -> Column:
    return F.when(unit.isin("%", "％"), "percent").when(unit.contains("美元"), "usd").when(unit.contains("港元"), "hkd").otherwise("rmb")


def canonical(value: Column, unit: Column) -> Column:
    return (value.cast("decimal(26,6)") * unit_scale(unit).cast("decimal(10,0)")).cast("decimal(30,6)")


def decimal_text(value: Column) -> Column:
    """A decimal without trailing zeros; minus zero is zero."""
    text = value.cast("string")
    text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")).otherwise(text)
    return F.when(text.isin("", "-0"), "0").otherwise(text)


def half_up(value: Column, digits: int = 2) -> Column:
    return F.round(value.cast("decimal(30,10)"), digits)


def annual_period(text: Column) -> Column:
    """2024, 2024年, 2024年度 and 2024年报 are one annual period; null for anything else."""
    bare = F.regexp_replace(text, "\\s", "")
    return F.when(bare.rlike("^[0-9]{4}(年|年度|年报)?$"), F.concat(F.left(bare, F.lit(4)), F.lit("年度")))


def previous_period(period: Column) -> Column:
    """The same period of the year before; null if it does not begin with a year."""
    year = F.regexp_extract(period, "^(20[0-9]{2})", 1)
    return F.when(year != "", F.concat((year.try_cast("int") - 1).cast("string"), F.substring(period, 5, 100)))


def normal_period(period: Column) -> Column:
    """One spelling of each period, by which two are compared."""
    p = F.regexp_replace(period, "\\s", "")
    p = F.regexp_replace(F.regexp_replace(p, "半年度$", "上半年"), "年年", "年")
    p = F.regexp_replace(p, "年(一|二|三|四)季度$", "年第$1季度")
    p = F.regexp_replace(p, "(年度|年报)$", "年")
    return F.when(p.rlike("^20[0-9]{2}$"), F.concat(p, F.lit("年"))).otherwise(p)


def same_period(a: Column, b: Column, lenient: bool = False) -> Column:
    """Equal once normalised; leniently, also if only the years are known and equal."""
    out = normal_period(a) == normal_period(b)
    if lenient:
        bare = normal_period(a).rlike("^20[0-9]{2}年$") | normal_period(b).rlike("^20[0-9]{2}年$")
        out = out | (bare & (F.left(a, F.lit(4)) == F.left(b, F.lit(4))))
    return F.coalesce(out, F.lit(False))


def page_number(line: Column) -> Column:
    """Whether a line holds nothing but a page number."""
    bare = F.regexp_replace(line, "\\s", "")
    return bare.rlike("^(第?[0-9]{1,4}页?|[0-9]{1,4}/[0-9]{1,4}|第[0-9]{1,4}页共[0-9]{1,4}页)$")


def checkboxes(text: Column) -> Column:
    """Ticked alternatives as words."""
    for pattern, stand_in in (
        ("[√☑✓]\\s*适用\\s*[□☐]\\s*不适用", "适用：是"),
        ("[□☐]\\s*适用\\s*[√☑✓]\\s*不适用", "适用：否"),
        ("[√☑✓]\\s*是\\s*[□☐]\\s*否", "是"),
        ("[□☐]\\s*是\\s*[√☑✓]\\s*否", "否"),
    ):
        text = F.regexp_replace(text, pattern, stand_in)
    return text


def heading(line: Column) -> Column:
    """The level of a heading (1 the highest), 0 for any other line."""
    t = F.trim(line)
    marks = F.length(F.regexp_extract(t, "^(#{1,6})\\s+\\S", 1))
    return (
        F.when(t.rlike("^[0-9.,%\\s]*$"), 0)
        .when(marks > 0, marks)
        .when(t.rlike("^第[一二三四五六七八九十百0-9]+[章节条]"), F.when(t.rlike("^第[^章节条]+章"), 1).when(t.rlike("^第[^章节条]+节"), 2).otherwise(3))
        .when(F.length(t) > 50, 0)
        .when(t.rlike("^[一二三四五六七八九十]+、"), 2)
        .when(t.rlike("^[0-9]+\\.[0-9]+\\s*\\S"), 4)
        .when(t.rlike("^[0-9]+[.、]\\s*\\S"), 3)
        .otherwise(0)
    )


# Fixed value: what a page's header is, white space aside.
PAGE_HEADER = r".{2,40}(?:19|20)\d{2}年(?:半年度|年度)?报告(?:全文|摘要)?"


def header_line(text: Column) -> Column:
    """A chunk that is only a page header, of 45 characters at most."""
    bare = F.regexp_replace(text, "\\s", "")
    return (F.length(bare) <= 45) & bare.rlike(f"^(?:{PAGE_HEADER})$")


def squeezed(text: Column) -> Column:
    """Without white space and in lower case, for tests of containment."""
    return F.regexp_replace(F.lower(text), "\\s", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """A text's signature by a key that the plan holds."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The UUID of version 5 of a name in a namespace."""
    h = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
