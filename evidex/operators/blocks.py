"""Table context that runs over blocks, and chunks of annotated blocks.

A document's blocks are read in order by a small state machine, so a document is one group; blocks of a
document are bounded by its text. Everything else is expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunking, facts

NUMBERS = re.compile(r"\d[\d,.]*")
SENTENCE = re.compile("[。！？!?；;]")
CONTEXT = ["table_name", "statement_scope", "report_period", "unit", "table_id", "is_table"]
_PLAIN = {"table_name": "", "statement_scope": "unknown", "report_period": "", "unit": "", "table_id": "", "is_table": False}


def continues(text: str) -> bool:
    """Whether a block without a title can belong to the table before it: a unit, a header, rows of amounts, or a continued table."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not lines or facts.table_title(text):
        return False
    if "续表" in text:
        return any(len(NUMBERS.findall(x)) >= 2 for x in lines)
    rows = [x for x in lines if "\t" in x or re.search(r"\s{2,}|\|", x)]
    numeric = sum(len(NUMBERS.findall(x)) >= 2 for x in rows)
    told = any(facts._ALIAS.search(facts.squeeze(x)) and facts.values_in(facts.squeeze(x), "") for x in lines)
    plain = not any(SENTENCE.search(x) for x in lines)
    return plain and (bool(facts.unit_of(text)) or told or any(re.search("项目|科目|本期|上期", x) for x in lines) or (len(rows) >= 2 and numeric >= 2))


def continuation(text: Column) -> Column:
    return F.pandas_udf(lambda texts: texts.map(lambda t: continues(t or "")), "boolean")(text)


def compatible(active: dict, local: dict) -> bool:
    """Stated units, full periods and scopes of two neighbours agree."""

    def clash(key, blank=("", "unknown")):
        return active[key] not in blank and local[key] not in blank and active[key] != local[key]

    bare = re.fullmatch(r"20\d\d年", local["report_period"] or "")
    return not (clash("unit") or clash("statement_scope") or (clash("report_period") and not bare))


def annotate(rows: list[dict], period: str = "") -> list[dict]:
    """Blocks (text, page, section_path) in order, with their table's context; a later block fills blanks of earlier ones of its table."""
    out, active, tables = [], None, 0
    for row in rows:
        local = {**_PLAIN, **facts.context_of(row["text"] or "")}
        if period and (not local["report_period"] or re.fullmatch(r"20\d\d年", local["report_period"])):
            local["report_period"] = period
        near = active is not None and (active["page"] is None or row["page"] is None or 0 <= row["page"] - active["page"] <= 1)
        if local["table_name"]:
            same = near and active["table_name"] == local["table_name"] and active["section_path"] == row["section_path"]
        else:
            same = near and active["table_name"] != "" and continues(row["text"] or "")
        if same and compatible(active, local):
            for key in ("statement_scope", "report_period", "unit"):
                local[key] = local[key] if local[key] not in ("", "unknown") else active[key]
            local |= {"table_name": active["table_name"], "table_id": active["table_id"], "is_table": True}
            for earlier in out:
                if earlier["table_id"] == local["table_id"]:
                    for key in ("statement_scope", "report_period", "unit"):
                        if earlier[key] in ("", "unknown"):
                            earlier[key] = local[key]
        elif local["is_table"]:
            local["table_id"] = f"table-{tables}"
            tables += 1
        else:
            local = dict(_PLAIN)
        out.append({**row, **local})
        active = out[-1] if local["is_table"] else None
    return out


def annotated(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc, block_no, page, section_path, text, doc_period) with the columns of ``CONTEXT``."""
    fields = "doc long, block_no int, page int, section_path string, text string, doc_period string"
    schema = fields + ", table_name string, statement_scope string, report_period string, unit string, table_id string, is_table boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_no")
        rows = [{**r, "page": None if pd.isna(r["page"]) else int(r["page"])} for r in pdf.to_dict("records")]
        done = annotate(rows, next((p for p in pdf["doc_period"] if p), "") or "")
        return pd.DataFrame(done).astype({"page": "Int32"})[[f.split()[0] for f in schema.split(", ")]]

    return blocks.select(*[f.split()[0] for f in fields.split(", ")]).groupBy("doc").applyInPandas(run, schema)


def flat_chunks(blocks: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Chunks of annotated blocks: (doc, chunk_index, text, section_path, page_start, page_end, table_name, ...).

    Neighbours merge while they fit and stand in no two different tables, in one fold over the document's
    pieces; a merged chunk has the path that both begin with and the pages of both.
    """
    names = ("table_name", "statement_scope", "report_period", "unit", "table_id", "is_table")
    piece = F.struct(F.col("block_no"), F.col("i"), F.col("t").alias("text"), F.coalesce("section_path", F.lit("")).alias("path"), F.col("page").alias("first"), F.col("page").alias("last"), *names)
    rows = blocks.select("doc", "block_no", "section_path", "page", *names, F.posexplode(chunking.packed(F.col("text"), size, overlap)).alias("i", "t")).select("doc", piece.alias("p"))
    pieces = rows.groupBy("doc").agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def put(done, p):
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(last["text"]) + F.length(p["text"]) + 2 <= size) & chunking.mergeable(last["table_id"], p["table_id"])
        merged = F.struct(
            last["block_no"].alias("block_no"), last["i"].alias("i"), F.concat(last["text"], F.lit("\n\n"), p["text"]).alias("text"), chunking.common_path(last["path"], p["path"]).alias("path"),
            F.least(last["first"], p["first"]).alias("first"), F.greatest(last["last"], p["last"]).alias("last"), *[last[n].alias(n) for n in names],
        )
        return F.when(fits, F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), merged)).otherwise(F.array_append(done, p))

    folded = pieces.select("doc", F.aggregate("ps", F.slice("ps", 1, 0), put).alias("cs"))
    out = folded.select("doc", F.posexplode("cs").alias("chunk_index", "c"))
    return out.select("doc", "chunk_index", F.col("c.text").alias("text"), F.col("c.path").alias("section_path"), F.col("c.first").alias("page_start"), F.col("c.last").alias("page_end"), *[F.col(f"c.{n}").alias(n) for n in names])


def parent_child(blocks: DataFrame, parent: int = chunking.PARENT, child: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Parents of neighbouring blocks with one section and table, and their children: (doc, kind, parent, n, text, section_path)."""
    w = Window.partitionBy("doc").orderBy("block_no")
    new = ~F.col("section_path").eqNullSafe(F.lag("section_path").over(w)) | ~F.col("table_id").eqNullSafe(F.lag("table_id").over(w))
    runs = blocks.withColumn("_g", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"])
    groups = runs.groupBy("doc", "_g").agg(F.array_join(texts, "\n\n").alias("text"), F.first("section_path").alias("section_path"))
    cut = groups.select("doc", "_g", "section_path", F.posexplode(chunking.packed(F.col("text"), parent, min(overlap, parent - 1))).alias("_p", "text"))
    key = F.concat_ws("-", F.col("doc").cast("string"), F.lit("p"), F.col("_g").cast("string"), F.col("_p").cast("string"))
    parents = cut.withColumn("parent", key)
    children = parents.select("doc", "parent", "section_path", F.posexplode(chunking.packed(F.col("text"), child, overlap)).alias("n", "text"))
    return parents.select("doc", F.lit("parent").alias("kind"), "parent", F.lit(0).alias("n"), "text", "section_path").unionByName(children.select("doc", F.lit("child").alias("kind"), "parent", "n", "text", "section_path"))


def related(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked chunk, its parent's row and its siblings: (asked, chunk), distinct."""
    own = asked.select(F.col("chunk").alias("asked")).join(chunks.select(F.col("chunk").alias("asked"), "parent"), "asked")
    siblings = own.join(chunks.select("chunk", "parent"), "parent").select("asked", "chunk")
    return siblings.unionByName(own.select("asked", F.col("parent").alias("chunk"))).filter("chunk IS NOT NULL").distinct()
