import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evidex.llm import simhash


def plain(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=4):
    """Smallest index reachable, by brute force."""
    n = len(prints)
    label = list(range(n))
    for _ in range(n):
        new = [min([label[j] for j in range(n) if bin(prints[i] ^ prints[j]).count("1") <= radius]) for i in range(n)]
        if new == label:
            break
        label = new
    return label


def test_fingerprint_by_definition():
    rng = random.Random(1)
    for text in [None, "", " \t", "A", "a b c", "a b c d", "ÀÉ İ b\x0bc\x0cd e\x85f", *(" ".join(rng.choice("abc dé") for _ in range(n)) for n in range(1, 60))]:
        assert simhash.fingerprint(text) == plain(text)


def test_cells_lose_no_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(6)]
    x = np.unique(np.array(x, np.uint64))
    want = classes([int(v) for v in x])
    for cut in (0, 50, 120):
        parts = [(x, None)] if not cut else [(x[:cut], None), (x[cut:], None), (x[:cut], x[cut:])]
        parent = np.arange(len(x))
        for a, b in parts:
            m, r = simhash.cell_links(a, b, 4, 16)
            parent = simhash._settle(parent, np.searchsorted(x, m), np.searchsorted(x, r))
        assert [int(v) for v in parent] == want


def test_strips_share_a_cell():
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64).repeat(9) ^ (np.uint64(1) << rng.integers(0, 60, 540, dtype=np.uint64)))
    for a, b in ((x, None), (x[:200], x[200:])):
        whole = np.arange(len(x))
        m, r = simhash.cell_links(a, b, 4, 16)
        whole = simhash._settle(whole, np.searchsorted(x, m), np.searchsorted(x, r))
        parts = np.arange(len(x))
        for k in range(5):
            m, r = simhash.cell_links(a, b, 4, 16, k, 5)
            parts = simhash._settle(parts, np.searchsorted(x, m), np.searchsorted(x, r))
        assert (whole == parts).all() and len(np.unique(whole)) < len(x)


def test_hot_fingerprints_and_others_are_all_named(spark, monkeypatch):
    rows = [(i, "the same text of more than a few words") for i in range(200)] + [(1000 + i, f"w{i} " * 3 + f"x{i} y{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 4, 5000):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = sorted((r["id"], r["component"]) for r in simhash.near_duplicates(df).collect())
        assert [i for i, _ in got] == [i for i, _ in rows] and {c for i, c in got if i < 200} == {0}


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(-5, 900), (900, 900)]
    random.Random(3).shuffle(edges)
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[k] == 100 for k in range(100, 140)) and found[900] == found[-5] == -5


def test_components_match_brute_force(spark, docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 300]))]
        for k in range(rng.choice([1, 2, 6])):
            own = list(text)
            if k and len(own) > 100:
                own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows) * 7 % 101, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: r for r in simhash.near_duplicates(df).collect()}
    rows.sort()
    prints = [plain(t) for _, t in rows]
    want = [rows[k][0] for k in classes(prints)]
    assert [found[i]["component"] for i, _ in rows] == want
    assert [found[i]["fp"] % 2**64 for i, _ in rows] == prints


def test_blocks_give_the_same(spark):
    rng = np.random.default_rng(2)
    x = np.unique(np.concatenate([rng.integers(0, 2**63, 300), rng.integers(0, 2**63, 20).repeat(8) ^ (1 << rng.integers(0, 60, 160))]).astype(np.int64))
    nodes = spark.createDataFrame([(int(v),) for v in x], "fp long")
    one = {tuple(r) for r in simhash.components(simhash.fingerprint_links(nodes)).collect()}
    many = {tuple(r) for r in simhash.components(simhash.fingerprint_links(nodes, block=40)).collect()}
    assert one == many and one


def test_edge_rows(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert {by[k][0]["component"] for k in (3, 4, 5)} == {3} and by[3][0]["fp"] == 0
    assert by[2][0]["component"] == 1 and len(by[7]) == 2
    assert [r["component"] for r in by[None]] == [None, None]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(docs, no_docs):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, 1, 3, 6, 7, 9]
    assert simhash.one_of_each(no_docs).count() == 0


def test_one_of_each_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two three four", "p", 7, 9), (2, "one two three four", "q", 8, 9), (None, "five six seven eight", "r", 9, 9)], "doc_id long, text string, _n string, _fp int, _grp int")
    got = simhash.one_of_each(df.withColumn("_row", F.lit("own")))
    assert got.columns == ["doc_id", "text", "_n", "_fp", "_grp", "_row"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "one two three four", "p", 7, 9, "own"), (None, "five six seven eight", "r", 9, 9, "own")]


def test_one_of_each_chooses_rows_not_ids(spark):
    a, b = "one two three four five six seven eight nine ten", "wholly other words that stand in no text but this one here"

    def left(*rows):
        got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        return sorted(map(tuple, got), key=str)

    assert left((5, a), (5, b)) == [(5, a), (5, b)]
    assert left((5, a), (5, b), (3, b.upper())) == [(3, b.upper()), (5, a)]
    assert left((5, a), (5, a), (5, b), (None, b), (None, "x y")) == [(5, a), (5, b), (None, "x y")]
