"""Documents to chunks: units, windows, greedy packing, links and neighbours, without Python.

All work on a document is expressions over its own row, so there is no shuffle before the chunks exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP, PARENT = 800, 100, 1600


def units(text: Column, separator: str = "\\n\\s*\\n") -> Column:
    """Paragraphs, headings, tables: what blank lines part, trimmed, empty ones dropped."""
    strip = F.transform(F.split(text, separator), lambda u: F.regexp_replace(u, "^\\s+|\\s+$", ""))
    return F.filter(strip, lambda u: u != "")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of characters, each beginning ``size - overlap`` after the last."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substr(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def is_table(unit: Column) -> Column:
    lines = F.split(unit, "\\n")
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: (F.trim(x) == "") | F.ltrim(x).startswith("|"))


def table_pieces(unit: Column, size: int = SIZE) -> Column:
    """A Markdown table in pieces that each repeat its first two lines."""
    lines = F.split(unit, "\\n")
    head = F.trim(F.array_join(F.slice(lines, 1, 2), "\n"))
    body = F.when(F.size(lines) > 2, F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.array().cast("array<string>").alias("done"), head.alias("now"))

    def put(state, line):
        longer = F.concat(state["now"], F.lit("\n"), line)
        full = F.length(longer) > size
        return F.struct(F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"), F.when(full, F.concat(head, F.lit("\n"), line)).otherwise(longer).alias("now"))

    return F.aggregate(body, start, put, lambda s: F.array_append(s["done"], s["now"]))


def packed(text: Column, size: int = SIZE, overlap: int = OVERLAP, separator: str = "\\n\\s*\\n") -> Column:
    """Chunks of whole units, filled greedily; a unit that is too long becomes windows, or pieces if it is a table."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def flushed(s):
        return F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"])

    def put(s, u):
        long = F.length(u) > size
        full = (s["now"] != "") & (F.length(s["now"]) + F.length(u) + 2 > size)
        pieces = F.when(is_table(u), table_pieces(u, size)).otherwise(windows(u, size, overlap))
        done = F.when(long, F.concat(flushed(s), pieces)).when(full, F.array_append(s["done"], s["now"])).otherwise(s["done"])
        now = F.when(long, "").when(full | (s["now"] == ""), u).otherwise(F.concat(s["now"], F.lit("\n\n"), u))
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(units(text, separator), start, put, flushed)


def chunks(docs: DataFrame, pieces: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, chunk_index, chunk, text, previous_chunk, next_chunk) from an array of texts per document.

    Neighbours are positions in the row's own array, so no window is needed for them.
    """
    # the pieces are made once, then counted and dealt out
    rows = docs.select(F.col(doc).alias("doc"), pieces.alias("_pieces")).select("doc", F.size("_pieces").alias("n"), F.posexplode("_pieces").alias("chunk_index", "text"))

    def name(i):
        return F.concat_ws("-", F.col("doc").cast("string"), i.cast("string"))

    i = F.col("chunk_index")
    return rows.select("doc", "chunk_index", name(i).alias("chunk"), "text", F.when(i > 0, name(i - 1)).alias("previous_chunk"), F.when(i + 1 < F.col("n"), name(i + 1)).alias("next_chunk"))


def linked(rows: DataFrame, doc: str = "doc", at: str = "chunk_index") -> DataFrame:
    """Rows with the places of those before and behind them in their document."""
    w = Window.partitionBy(doc).orderBy(at)
    return rows.withColumn("previous", F.lag(at).over(w)).withColumn("next", F.lead(at).over(w))


def with_parents(rows: DataFrame, parent: int = PARENT, size: int = SIZE) -> DataFrame:
    """Chunks with the parent they belong to: ``parent // size`` chunks in a row share one."""
    each = max(1, parent // size)
    return rows.withColumn("parent", F.concat_ws("-", F.col("doc").cast("string"), F.lit("p"), F.floor(F.col("chunk_index") / each).cast("string")))


def around(rows: DataFrame, hops: int = 1, doc: str = "doc", at: str = "chunk_index", text: str = "text", sep: str = "\n") -> DataFrame:
    """Each chunk with the text of those up to ``hops`` before and behind it, in order: a bounded frame over the document's order."""
    w = Window.partitionBy(doc).orderBy(at).rowsBetween(-hops, hops)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), sep))


def page_span(*columns: str) -> tuple[Column, Column]:
    """The least and greatest page of some columns, nulls aside."""
    return F.least(*columns), F.greatest(*columns)


def common_path(a: Column, b: Column, sep: str = " > ") -> Column:
    """The parts that two section paths begin with alike."""
    p, q = F.split(a, sep), F.split(b, sep)
    same = F.zip_with(F.slice(p, 1, 64), F.slice(q, 1, 64), lambda x, y: x.eqNullSafe(y))
    bad = F.array_position(same, F.lit(False).cast("boolean"))
    n = F.when(bad > 0, bad - 1).otherwise(F.least(F.size(p), F.size(q)))
    return F.when(n > 0, F.array_join(F.slice(p, F.lit(1), n.cast("int")), sep)).otherwise("")


def mergeable(a: Column, b: Column) -> Column:
    """Tables of different names never merge."""
    return (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (a == b)


def back_filled(blocks: DataFrame, columns=("table_name", "statement_scope", "report_period", "unit"), table: str = "table_id", order: str = "block_no") -> DataFrame:
    """Blank context of a table's earlier blocks from the first later one that has it."""
    w = Window.partitionBy("doc", table).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for c in columns:
        known = F.when(~F.col(c).isin("", "unknown"), F.col(c))
        later = F.first(known, ignorenulls=True).over(w)
        blocks = blocks.withColumn(c, F.when(F.col(table) != "", F.coalesce(later, F.col(c))).otherwise(F.col(c)))
    return blocks


def only_value(column: str) -> Column:
    """An aggregate: the one value that is not blank, else blank."""
    some = F.collect_set(F.when(F.col(column) != "", F.col(column)))
    return F.when(F.size(some) == 1, F.element_at(some, 1)).otherwise("")


def sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, block_no, section_path, text): blocks between headings, each with the stack of headings above it.

    A row's own lines are folded into blocks by one aggregate, in order.
    """
    from ..functions.text import heading

    lines = F.split(F.col(text), "\\n")
    block = "array<struct<path: array<string>, body: array<string>>>"
    start = F.struct(F.array().cast(block).alias("done"), F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("body"))

    def closed(s):
        return F.when(F.size(s["body"]) > 0, F.array_append(s["done"], F.struct(s["path"].alias("path"), s["body"].alias("body")))).otherwise(s["done"])

    def put(s, line):
        level = heading(line)
        title = F.trim(F.regexp_replace(line, "^\\s*#{1,6}\\s+", ""))
        # the stack keeps a place for each level; a heading clears those below it
        above = F.slice(F.concat(s["path"], F.array_repeat(F.lit(""), 6)), F.lit(1), F.greatest(level - 1, F.lit(0)))
        path = F.when(level > 0, F.array_append(above, title)).otherwise(s["path"])
        return F.struct(F.when(level > 0, closed(s)).otherwise(s["done"]).alias("done"), path.alias("path"), F.when(level > 0, F.array().cast("array<string>")).otherwise(F.array_append(s["body"], line)).alias("body"))

    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(F.aggregate(lines, start, put, closed)).alias("block_no", "b"))
    path = F.array_join(F.filter("b.path", lambda p: p != ""), " > ")
    return rows.select("doc", "block_no", path.alias("section_path"), F.array_join("b.body", "\n").alias("text"))
