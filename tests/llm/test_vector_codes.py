import hashlib
import math

import numpy as np
import pyarrow as pa

from evidex.llm import vector_codes as v


def plain(rows, parts=8, entries=16, rounds=6):
    """By the definition, with Python's integers: rows of (id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in vec], label) for i, vec, label in rows if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    size = len(kept[0][1]) // parts
    starts = sorted({i: x for i, x, _ in reversed(kept)}.items(), key=lambda r: (r[0] is None, r[0]))[:entries]
    books = [[x[p * size : (p + 1) * size] for _, x in starts] for p in range(parts)]

    def assigned(p, x):
        own = x[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(own, entry)), k) for k, entry in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[assigned(p, x)[1] for _, x, _ in kept] for p in range(parts)]
        for p in range(parts):
            for k in set(codes[p]):
                own = [x[p * size : (p + 1) * size] for (_, x, _), c in zip(kept, codes[p]) if c == k]
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = [[assigned(p, x) for p in range(parts)] for _, x, _ in kept]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), min(e, v.LONG), min(by_label[label], v.LONG), sha) for (i, _, label), f, e in zip(kept, found, errors)]


def rows(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data, kind="array<float>"):
    return spark.createDataFrame([(*r, "clash", 1) for r in data], f"vec_id long, embedding {kind}, label int, row string, parts int")


def test_equals_the_definition(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.3, (300, 16)).astype(np.float32)
    x[100:220] = x[7]  # a vector that many rows share, and a part that more do
    x[:, :2] = np.round(x[:, :2])
    data = [(i, vec.tolist(), [None, 1, 2][i % 3]) for i, vec in enumerate(x)]
    data += [(5, data[5][1], 2), (1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] * 16, None), (1003, [float("inf")] * 16, 1), (None, data[3][1], 1), (None, data[3][1], 1)]
    df = frame(spark, data)
    assert rows(v.coded(df)) == sorted(plain(data), key=repr)
    assert v.coded(df.limit(0)).count() == 0


def test_all_ways_of_joining_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(i, (rng.integers(-3, 4, 8) / 2).tolist(), int(i % 5)) for i in range(200)]
    want = sorted(plain(data), key=repr)
    for shared, labels in ((2, 0), (50, 100), (10**9, 0)):
        monkeypatch.setattr(v, "SHARED", shared)
        monkeypatch.setattr(v, "LABELS", labels)
        assert rows(v.coded(frame(spark, data))) == want


def test_fewer_ids_than_entries_and_large_components(spark):
    data = [(i, [1e9 * (i + 1), -3.5e11, 0.25, 1e5, 0.0, -1.0, 1e-9, -1e-9], 1) for i in range(5)]
    assert rows(v.coded(frame(spark, data, "array<double>"))) == sorted(plain(data), key=repr)
    held = v.coded(frame(spark, [(1, [1e300] * 8, 1), (2, [-1e300] * 8, None)], "array<double>")).collect()
    assert {r["error"] for r in held} == {0}
    assert v.nearest(np.array([[v.MOST]]), np.array([0]), [[[v.LEAST]]])[1][0] == (v.MOST - v.LEAST) ** 2


def test_vectors_of_another_length(spark):
    data = [(1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (3, [0.5] * 16, 1), (4, [0.5] * 3, 1), (5, [], None), (0, [0.5] * 7, 1)]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in v.coded(frame(spark, data)).collect()}
    assert got == {1: ("00" * 8, 0, 0), 2: ("00" * 8, 0, 0), 3: (None, None, 0), 4: (None, None, 0), 5: (None, None, None), 0: (None, None, 0)}
    only = v.coded(frame(spark, data[3:])).collect()
    assert {r["code"] for r in only} == {None} and len(only) == 3


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-(1 << b), 1 << b, (9, 5)) for b in (3, 15, 16, 31, 32, 61)])
    length, data = v.packed(x)
    assert set(length) == {10, 20, 40}
    column = v._binary(length, data)
    assert (v.unpacked(column, 5) == x).all() and (v.unpacked(column.slice(7, 11), 5) == x[7:18]).all()
    assert len(v.unpacked(pa.array([], pa.binary()), 5)) == 0
