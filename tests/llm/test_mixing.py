import math
import random
import re

from pyspark.sql import functions as F

from evidex.llm import mixing as m

DOCS = "doc_id long, text string, source string, key string, size string, name string, range int, target int"


def size_of(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    """By the definition: what is over a full target goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else share[s] for s in order}
        full |= above


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", 1, 1) for r in rows], DOCS)


def corpus(n=3000, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", "tiny", None, "\U0001f600"])
        if source == "tiny" and i > 60:
            source = "b"
        words = 0 if i % 50 == 0 else 3000 if i == 7 else rng.randint(1, 60)
        rows.append((i, " ".join(["word"] * words), source))
    return rows + [(5, rows[5][1], rows[5][2]), (None, "some words here", "a"), (None, "some words here", "a"), (9000, None, None), (9001, None, "empty"), (9002, " \t\n  x", "nbsp")]


def test_targets_and_words_taken(spark):
    rows = corpus()
    got = [r.asDict() for r in m.mixed(frame(spark, rows)).collect()]
    assert sorted((str(r["doc_id"]), r["source"] or "", r["size"]) for r in got) == sorted((str(i), s or "", size_of(t)) for i, t, s in rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets(sizes)
    assert sum(want.values()) == sum(sizes.values()) or math.isclose(sum(want.values()), sum(sizes.values()))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, s
        epochs = math.floor(t / sizes[s] + 1e-12) if sizes[s] else 0
        # whole epochs for all, one more for some, and at most one document that is cut
        more = [r["taken"] - min(epochs, 3) * r["size"] for r in got if r["source"] == s]
        assert all(x >= 0 for x in more) and sum(0 < x < r["size"] for x, r in zip(more, [r for r in got if r["source"] == s])) <= 1


def test_sorted_by_keys_within_a_source(spark):
    """The sample is what one sort of the source's keys gives, however the ranges are cut."""
    rows = [(i, f"w{i} " * (i % 9 + 1), "s" if i % 4 else "t") for i in range(2000)]
    df = frame(spark, rows)
    text, one = F.col("text"), F.lit(2.0) / (F.col("doc_id") % 5 + 1)
    keyed = df.select("doc_id", "source", m.words(text).alias("n"), (-F.log(m.uniform(F.col("doc_id"), text)) / one).alias("k")).collect()
    total = sum(r["n"] for r in keyed)
    sizes = {s: sum(r["n"] for r in keyed if r["source"] == s) for s in "st"}
    want = {}
    for s, t in targets(sizes).items():
        epochs = int(t // sizes[s])
        left = round(t - epochs * sizes[s])
        for r in sorted((r for r in keyed if r["source"] == s), key=lambda r: r["k"]):
            part = max(0, min(r["n"], left))
            want[r["doc_id"]], left = epochs * r["n"] + part, left - part
    for least, rows_each in ((64, 20_000), (1, 10**9), (3, 10)):
        m.RANGES, m.RANGE = least, rows_each
        got = {r["doc_id"]: r["taken"] for r in m.mixed(df, weight=2.0 / (F.col("doc_id") % 5 + 1)).collect()}
        assert got == want and sum(got.values()) == total
    m.RANGES, m.RANGE = 64, 20_000


def test_better_documents_are_drawn_more_often(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("one word").alias("text"), F.when(F.col("id") % 8 == 0, "a").otherwise("b").alias("source"))
    out = m.mixed(df, weights=(1, 3), weight=F.when(F.col("doc_id") % 16 < 8, 3.0).otherwise(1.0)).filter("source = 'b'")
    r = out.groupBy((F.col("doc_id") % 16 < 8).alias("good")).agg((F.sum("taken") / F.sum("size")).alias("share")).collect()
    share = {x["good"]: x["share"] for x in r}
    # all words are 80,000, source b has 70,000 of them and is to give 60,000: with weights 3 and 1 the chance not to be drawn is x^3 and x
    x = min((abs((1 - y**3) + (1 - y) - 2 * 60 / 70), y) for y in (i / 10_000 for i in range(10_001)))[1]
    assert abs(share[True] - (1 - x**3)) < 0.02 and abs(share[False] - (1 - x)) < 0.02


def test_reruns_empty_tables_and_one_source(spark):
    df = frame(spark, corpus(500, 1))
    once, again = (sorted(map(tuple, m.mixed(x).collect()), key=repr) for x in (df, df.repartition(7)))
    assert once == again
    assert m.mixed(df.limit(0)).count() == 0
    nothing = m.mixed(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert {(r["size"], r["source_size"], r["target"], r["taken"]) for r in nothing} == {(0, 0, 0.0, 0)}
    alone = m.mixed(frame(spark, [(1, "a b c", "x"), (2, "d", "x")])).collect()
    assert {(r["doc_id"], r["target"], r["taken"]) for r in alone} == {(1, 4.0, 3), (2, 4.0, 1)}


def test_many_sources_by_join(spark, monkeypatch):
    df = frame(spark, corpus(600, 2))
    want = sorted(map(tuple, m.mixed(df).collect()), key=repr)
    monkeypatch.setattr(m, "SENT", 0)
    assert sorted(map(tuple, m.mixed(df).collect()), key=repr) == want


def test_native_plan(spark):
    plan = m.mixed(frame(spark, corpus(50)))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
