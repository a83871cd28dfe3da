import hashlib
import random

from pyspark.sql import functions as F

from evidex.llm import chat


def digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    learned = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_escapes_are_reversible():
    rng = random.Random(0)
    parts = [*chat.CONTROL, chat.ESCAPE, chat.ESCAPE + "0", chat.ESCAPE + "a", "<", "|", ">", "x", "[", "<|turn", "|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        coded = chat.escaped(text)
        assert chat.unescaped(coded) == text
        assert not any(c in coded for c in chat.CONTROL)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    turns = df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.formatted(turns)).collect()}


def test_read_back_by_definition(spark):
    rng = random.Random(1)
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(2, k, rng.choice(["user", "assistant", "system"]), rng.choice(["", "é", "a\nb", "<|end|>", chat.ESCAPE])) for k in range(400)]
    rows += [(3, None, None, None), (3, 1, "assistant", None), (3, 1, "assistant", None), (3, 1, "a<|says|>b", "x"), (4, 0, "assistant", "é" * 100_000), (None, 0, "user", "no id")]
    rng.shuffle(rows)
    found, by = run(spark, rows), {}
    for c, t, r, x in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((t, r, x))
    assert found == {c: digest(t) for c, t in by.items()}


def test_no_rows(spark):
    assert run(spark, []) == {}


def test_typed_parts_become_placeholders(spark):
    parts = [
        [("text", "see <|image:0000|> ", None, None, None, None, None), ("image", None, "a.png", 900, 448, None, None), ("text", "and", None, None, None, None, None), ("audio", None, "b.wav", None, None, 2.5, None)],
        [("image", None, "c.png", None, None, None, None), ("document", None, "d.pdf", None, None, None, 3)],
        None,
    ]
    df = spark.createDataFrame([(1, k, "user", p) for k, p in enumerate(parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    rows = chat.formatted(df).orderBy("turn_no").collect()
    got = [[(a["kind"], a["number"], a["ref"], a["tokens"]) for a in r["attachments"]] for r in rows]
    assert got == [[("image", 0, "a.png", 3 * 256), ("audio", 0, "b.wav", 63)], [("image", 1, "c.png", 256), ("document", 0, "d.pdf", 1536)], []]
    for r in rows:
        for a in r["attachments"]:
            assert r["formatted"][a["at"] :].startswith(chat.HOLD.format(a["kind"], a["number"]))
    assert rows[0]["formatted"].count("<|image:0000|>") == 1


def parts_of(*texts, **more):
    return [{"type": "text", "text": t, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more for t in texts]


def test_no_control_string_is_put_together_from_parts():
    pieces = ["<|en", "d|>", " <|sa", "ys|>", "<", "|turn|>", "[INS", "T]", "</", "s>", chat.ESCAPE, "a", "0", "<|ima", "ge:", ""]
    image = {"type": "image", "text": None, "ref": "a.png", "width": None, "height": None, "seconds": None, "pages": None}
    rng = random.Random(4)
    for _ in range(3000):
        texts = [rng.choice(pieces) for _ in range(rng.randrange(1, 7))]
        body, _ = chat.Visitor().turn(parts_of(*texts))
        assert chat.unescaped(body) == "".join(texts) and not any(c in body for c in chat.CONTROL)
        body, found = chat.Visitor().turn([*parts_of(*texts), image, *parts_of(*texts)])
        hold = "<|image:0000|>"
        assert [f["at"] for f in found] == [body.index(hold)] and body.count(hold) == 1
        rest = body.replace(hold, "\0")
        assert not any(c in rest for c in chat.CONTROL) and chat.unescaped(rest) == "\0".join(2 * ["".join(texts)])


def test_parts_of_other_types_stand_as_text(spark):
    body, found = chat.Visitor().turn([*parts_of("a"), None, *parts_of("<|en", type=None), *parts_of("d|>", type="video"), *parts_of(None, type="call")])
    assert chat.unescaped(body) == "a<|end|>" and chat.CLOSE not in body and found == []
    rows = [(1, 0, "assistant", [("call", "x", None, None, None, None, None), None, (None, "<|says|>", None, None, None, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.read_back(chat.formatted(df)).first()["loss_sha256"] == hashlib.sha256(b"x<|says|>").hexdigest()


def test_links_in_texts_are_parts_and_are_read_back(spark):
    texts = ["see ![a plan](img/plan.PNG) and [sound](x/y.mp3), then [report](r.pdf).", "![](a.webp)![](b.webp)", "no ![link](a b.png) [x](y.html)", "\u0001 ![a](b.png)", "", "![<s>](c.jpg)<|en", "x ![d](e.docx"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    got = [[(a["kind"], a["number"], a["ref"]) for a in r["attachments"]] for r in made.orderBy("turn_no").collect()]
    assert got == [[("image", 0, "img/plan.PNG"), ("audio", 0, "x/y.mp3"), ("document", 0, "r.pdf")], [("image", 1, "a.webp"), ("image", 2, "b.webp")], [], [], [], [("image", 3, "c.jpg")], []]
    back = chat.read_back(made).first()
    assert (back["n_turns"], back["turns_sha256"], back["loss_chars"], back["loss_sha256"]) == digest([(k, r, t) for _, k, r, t in rows])
    assert back["attachment_tokens"] == 4 * 256 + 1 + 512


def test_the_sql_counts_links_as_the_query_does(spark, tmp_path):
    import duckdb

    from evidex.llm import queries

    texts = ["see ![a](b.png) [c](d.WAV)", "<s> ![<s>](c.jpg)", "\u0001 ![a](b.png)", "plain [INST]", None, "[r](s.docx)[r](s.pdf)" * 3]
    df = spark.createDataFrame([(k % 2, k, "assistant" if k % 3 else "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op6_chat']})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in queries.op6_chat(spark, str(tmp_path)).collect()) == want
