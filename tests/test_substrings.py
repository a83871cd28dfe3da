import random

import pytest
from pyspark.sql import functions as F

from evidex.operators import substrings


def plain(texts, needles):
    return sorted((i, k, t) for i, n in needles for k, t, x in texts if n and x and n in x)


def rows(spark, texts, needles):
    t = spark.createDataFrame(texts, "k int, tag string, text string")
    n = spark.createDataFrame(needles, "item int, needle string")
    return sorted(map(tuple, substrings.occurrences(t, n).select("item", "k", "tag").collect()))


@pytest.fixture
def data():
    rng = random.Random(0)
    letters = ["a", "b", "世", "\U0001f600", " ", "é"]

    def text(n):
        return "".join(rng.choices(letters, k=n))

    texts = [(i, f"t{i % 3}", text(rng.randint(0, 200))) for i in range(150)] + [(900, "x", None), (901, "x", ""), (902, "y", "a" * 3000), (3, "t0", "repeated"), (3, "t0", "repeated")]
    needles = [(i, text(rng.randint(1, 70))) for i in range(300)]
    for i in range(300, 500):  # some that occur
        t = rng.choice(texts[:150])[2] or "ab"
        at = rng.randrange(len(t))
        needles.append((i, t[at : at + rng.randint(1, 90)]))
    return texts, [*needles, (600, ""), (601, None), (602, "a" * 40), (603, "a" * 40), (604, "repeated"), (605, "zz"), (606, "a" * 2999)]


def test_equals_a_plain_search(spark, data, monkeypatch):
    texts, needles = data
    want = plain(texts, needles)
    assert len(want) > 1000 and rows(spark, texts, needles) == want
    # other windows, blocks of strings and the join by a shuffle give the same
    monkeypatch.setattr(substrings, "SENT", 0)
    monkeypatch.setattr(substrings, "AT_ONCE", 150)
    assert rows(spark, texts, needles) == want


def test_windows_overlap(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choices("abc", k=2000))
    needles = [(i, text[i * 9 : i * 9 + 1 + i % 13]) for i in range(200)]
    known = substrings.Table
    for window in (16, 64, 2000):
        monkeypatch.setattr(substrings, "WINDOW", window)
        substrings._powers.cache_clear()
        import pyarrow as pa

        digest = next(iter(substrings._known([pa.record_batch([pa.array([n for _, n in needles])], names=["needle"])])))
        part, hashes, offset, length, full = (digest.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        tables = {int(n): known(hashes[part == n].view("u8"), offset[part == n], length[part == n], full[part == n].view("u8")) for n in set(part.tolist())}
        schema = pa.schema([("k", pa.int32()), ("_stretch", pa.string())])
        batch = pa.record_batch([pa.array([7], pa.int32()), pa.array([text])], names=["k", "text"])
        got = {r["_stretch"] for b in substrings._seek(tables, 13, schema)([batch]) for r in b.to_pylist()}
        assert got == {n for _, n in needles}
    substrings._powers.cache_clear()


def test_nothing_to_look_for(spark):
    t = spark.createDataFrame([(1, "a")], "k int, text string")
    n = spark.createDataFrame([(1, ""), (2, None)], "item int, needle string")
    assert substrings.occurrences(t, n).columns == ["item", "k"] and substrings.occurrences(t, n).count() == 0
    assert substrings.occurrences(t.limit(0), n.withColumn("needle", F.lit("a"))).count() == 0


def test_strings_that_share_a_part(spark):
    """Many strings around one common passage, and a text that repeats it: no pair is lost, and only equal stretches count."""
    common = "the same common passage in all of them"
    needles = [(i, f"{i:04d}{common}{i:04d}") for i in range(1500)] + [(2000, common)]
    texts = [(i, "t", " ".join(f"{j:04d}{common}{j:04d}" for j in range(i, i + 5))) for i in range(0, 1500, 100)] + [(5000, "t", f"{common} {common}")]
    assert rows(spark, texts, needles) == plain(texts, needles)


def test_plan_has_no_nested_loop(spark, data):
    texts, needles = data
    t, n = spark.createDataFrame(texts, "k int, tag string, text string"), spark.createDataFrame(needles, "item int, needle string")
    plan = substrings.occurrences(t, n)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_texts_are_searched_for_long_strings(spark, monkeypatch):
    """Texts that cannot hold a string do not get to the search, and none that holds one is left out."""
    rng, blanks = random.Random(3), " \t\n\x0b\f\r"
    needles = ["".join(rng.choice("abcdeé0") for _ in range(n)) for n in (60, 80, 150)] + ["k" * 39 + "i" * 39]
    rows = [(i, "".join(rng.choice("abcdeé0 AB") for _ in range(rng.randint(0, 400)))) for i in range(300)] + [(-1, None), (-2, "\u212a" * 39 + "I" * 39), (-3, "")]
    rows += [(1000 + i, rows[i][1] + "".join(rng.choice(["", *blanks]) + c.upper() for c in needles[i % 4]) + rows[i + 1][1]) for i in range(40)]
    texts, wanted = spark.createDataFrame(rows, "doc int, text string"), spark.createDataFrame(list(enumerate(needles)), "item int, needle string")
    want = {i for i, t in rows if t and any(n in t.translate(dict.fromkeys(map(ord, blanks))).lower() for n in needles)}
    assert {1000 + i for i in range(40)} | {-2} <= want
    for size in (1 << 18, 50):
        monkeypatch.setattr(substrings, "AT_A_TIME", size)
        assert {r["doc"] for r in substrings.likely(texts, wanted, without=blanks).collect()} == want
    short = wanted.union(spark.createDataFrame([(9, "ab")], wanted.schema))
    assert substrings.likely(texts, short, without=blanks).count() == len(rows)
    assert substrings.likely(texts, wanted.limit(0), without=blanks).count() == len(rows)
