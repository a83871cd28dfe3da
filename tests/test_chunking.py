import random
import re

from pyspark.sql import functions as F

from evidex.operators import chunking as c


def greedy(text, size, overlap):
    """The packing by plain loops, for texts without tables."""
    done, now = [], ""
    for u in [u.strip() for u in re.split(r"\n\s*\n", text) if u.strip()]:
        if len(u) > size:
            done += [now] if now else []
            now = ""
            done += [u[i : i + size] for i in range(0, len(u), max(size - overlap, 1))]
        elif now and len(now) + len(u) + 2 > size:
            done.append(now)
            now = u
        else:
            now = f"{now}\n\n{u}" if now else u
    return done + ([now] if now else [])


def test_greedy_packing_and_windows(spark):
    rng = random.Random(0)
    texts = ["", " \n\n ", "é" * 50] + ["\n\n".join("é" * rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", c.packed(F.col("text"), 30, 5).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == [greedy(t, 30, 5) for t in texts]
    for i, t in enumerate(texts):
        w = df.filter(F.col("doc_id") == i).select(c.windows(F.col("text"), 10, 3).alias("w")).first()["w"]
        assert w == [t[k : k + 10] for k in range(0, len(t), 7)]
        if i > 6:
            break


def test_tables_repeat_their_header(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row{i} | {i} |" for i in range(12))
    pieces = spark.createDataFrame([(table,)], "t string").select(c.packed(F.col("t"), 60, 5).alias("p")).first()["p"]
    assert len(pieces) > 2 and all(p.startswith("| a | b |\n| --- | --- |\n") and len(p) <= 60 for p in pieces)
    assert sum(p.count("row") for p in pieces) == 12


def test_links_and_context(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"])], "doc_id long, p array<string>")
    rows = c.chunks(df, F.col("p"))
    got = {r["chunk"]: (r["previous_chunk"], r["next_chunk"]) for r in rows.collect()}
    assert got == {"1-0": (None, "1-1"), "1-1": ("1-0", "1-2"), "1-2": ("1-1", None), "2-0": (None, None)}
    assert {r["chunk"]: r["context"] for r in c.around(rows, 1).collect()}["1-1"] == "a\nb\nc"
    assert {r["parent"] for r in c.with_parents(rows, 1600, 800).collect()} == {"1-p-0", "1-p-1", "2-p-0"}


def test_sections_keep_the_stack(spark):
    text = "intro\n# A\nx\n## B\ny\nz\n# C\nw"
    rows = c.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block_no").collect()
    assert [(r["section_path"], r["text"]) for r in rows] == [("", "intro"), ("A", "x"), ("A > B", "y\nz"), ("C", "w")]


def test_paths_and_back_fill(spark):
    df = spark.createDataFrame([("A > B > C", "A > B > D"), ("A", "B"), ("A > B", "A > B")], "a string, b string")
    assert [r["p"] for r in df.select(c.common_path(F.col("a"), F.col("b")).alias("p")).collect()] == ["A > B", "", "A > B"]
    blocks = spark.createDataFrame([(1, 0, "t", "", "unknown", "", ""), (1, 1, "t", "利润表", "consolidated", "2024年度", "元"), (1, 2, "", "", "unknown", "", "")], "doc int, block_no int, table_id string, table_name string, statement_scope string, report_period string, unit string")
    first = c.back_filled(blocks).orderBy("block_no").first()
    assert (first["table_name"], first["statement_scope"], first["unit"]) == ("利润表", "consolidated", "元")
