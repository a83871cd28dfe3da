"""Documents, manifests, reports and chunk stores as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are read as text here; the others need a parser from outside.
TEXT, OTHER = ("md", "txt"), ("pdf", "docx", "png", "jpg", "jpeg", "bmp", "webp", "jfif")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def scan(spark: SparkSession, root: str, extensions: Iterable[str] = TEXT + OTHER) -> DataFrame:
    """(path, length, modified, extension) of the files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), extension(F.col("path")).alias("extension")).filter(F.col("extension").isin(list(extensions))).dropDuplicates(["path"])


def documents(spark: SparkSession, root: str, parser=None) -> DataFrame:
    """(path, sha256, text) of the files below a folder; invalid UTF-8 is left out.

    ``parser``: a Column function (content, extension) -> text for formats that are not text; without one
    such files have a null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = extension(F.col("path"))
    # ill-formed bytes become the replacement character, which then goes
    plain = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    other = parser(F.col("content"), ext) if parser else F.lit(None).cast("string")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.when(ext.isin(*TEXT), plain).when(ext.isin(*OTHER), other).alias("text"))


def pages_text(pages: Column) -> Column:
    """Pages that are not empty, joined by blank lines."""
    return F.array_join(F.filter(pages, lambda p: F.trim(p) != ""), "\n\n")


def table_markdown(rows: Column) -> Column:
    """A table of cells as Markdown: two rows and two columns at least, short rows filled up; else null."""
    width = F.size(F.get(rows, F.lit(0)))

    def line(cells):
        full = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)
        clean = F.transform(full, lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "\\s*\\n\\s*", " "))
        return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))

    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when((F.size(rows) >= 2) & (width >= 2), F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines) - 1)), "\n"))


def layout_rows(boxes: DataFrame, gap: float = 0.12) -> DataFrame:
    """Recognised boxes (page, x, y, width, height, text, page_width) as rows of cells, by gaps in y and x.

    A row begins where y moves on by more than max(12, 0.75 of the height); a cell where x leaves a gap.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy("y", "x")
    new = F.when(F.col("y") - F.lag("y").over(w) > F.greatest(F.lit(12.0), F.col("height") * 0.75), 1).otherwise(0)
    rows = boxes.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("page", "row_no").orderBy("x")
    far = F.col("x") - F.lag(F.col("x") + F.col("width")).over(r) >= gap * F.col("page_width")
    cells = rows.withColumn("_sep", F.when(far, " | ").when(F.row_number().over(r) > 1, " ").otherwise(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x", F.concat("_sep", "text").alias("t")))), lambda s: s["t"])
    return cells.groupBy("page", "row_no").agg(F.array_join(parts, "").alias("line"))


def faq(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows (question, answer, similar) and bad ones (line, reason) of a CSV with a header."""
    return faq_rows(spark.read.csv(path, header=True, schema="question string, answer string, similar string", multiLine=True, escape='"').withColumn("line", F.monotonically_increasing_id()))


def faq_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (question, answer, similar) and bad ones (line, reason) of (line, question, answer, similar)."""
    reason = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "no question").when(F.trim(F.coalesce("answer", F.lit(""))) == "", "no answer")
    both = raw.withColumn("reason", reason)
    similar = F.filter(F.transform(F.split(F.coalesce("similar", F.lit("")), "[;；,，\\n]"), lambda s: F.trim(s)), lambda s: s != "")
    good = both.filter("reason IS NULL").select(F.trim("question").alias("question"), F.trim("answer").alias("answer"), F.array_distinct(similar).alias("similar"))
    return good, both.filter("reason IS NOT NULL").select("line", "reason")


def manifest(spark: SparkSession, path: str, declared: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries (path, size, sha256) of a TSV, and findings (path, finding): unsafe, repeated, clashing, miscounted."""
    rows = spark.read.csv(path, sep="\t", schema="path string, size long, sha256 string").select("path", "size", F.lower("sha256").alias("sha256"))
    p = F.col("path")
    unsafe = rows.filter(p.startswith("/") | p.contains("\\") | p.rlike("(^|/)\\.\\.?(/|$)")).select("path", F.lit("unsafe").alias("finding"))
    again = rows.groupBy("path").count().filter("count > 1").select("path", F.lit("repeated").alias("finding"))
    clash = rows.groupBy(F.lower("path").alias("low")).agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).filter("n > 1").select("path", F.lit("clash").alias("finding"))
    found = unsafe.unionByName(again).unionByName(clash)
    if declared is not None:
        found = found.unionByName(rows.agg(F.count("*").alias("n")).filter(F.col("n") != declared).select(F.lit(None).cast("string").alias("path"), F.lit("count").alias("finding")))
    return rows, found


def report_summary(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of a JSON report in either of its shapes: a summary of its own, or that of its first part."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    own = F.coalesce(F.try_variant_get("v", "$.summary", "variant"), F.try_variant_get("v", "$.reports[0].summary", "variant"))
    flat = F.from_json(F.to_json(own), "map<string, string>")
    return doc.select(F.explode(flat).alias("metric", "raw")).select("metric", F.expr("try_cast(raw AS double)").alias("value")).filter("value IS NOT NULL")


def chunks(spark: SparkSession, path: str, kb_id: str, condition: dict | None = None) -> DataFrame:
    """A knowledge base's chunks in the last version of a store; its name and the conditions reach the scan."""
    from ..functions.filters import where
    from .store import ChunkStore

    return where(ChunkStore(spark, path).read(kb_id=kb_id), condition)


def ocr_route(local_text: Column, scores: Column, mode: str = "auto", least: float = 0.6) -> Column:
    """Which recogniser's text to take: by mode, else by the local one's mean confidence and share of garbage."""
    if mode != "auto":
        return F.lit(mode)
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x), F.size(scores))
    garbage = F.length(F.regexp_replace(local_text, "[\\p{L}\\p{N}\\s]", "")) / F.greatest(F.length(local_text), F.lit(1))
    return F.when((mean >= least) & (garbage < 0.5) & (F.trim(local_text) != ""), "local").otherwise("external")


def fingerprint(config: dict, *contents: str) -> str:
    """A hash of a pipeline's configuration and sources."""
    import hashlib
    import json

    parts = [json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")), *contents]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()
