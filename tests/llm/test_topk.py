import numpy as np

from evidex.llm import topk


def brute(ids, x, k=10, every=100):
    v = np.floor(1024 * x).astype(np.int64)
    out = set()
    for i, q in zip(ids, v):
        if i % every == 0:
            s = v @ q
            best = sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != i)[:k]
            out |= {(int(i), r + 1, c, -m) for r, (m, c) in enumerate(best)}
    return out


def rows(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def test_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.2, (700, 64)).astype(np.float32)
    x[50:90] = x[3]  # more equal vectors than k
    x[200] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert rows(topk.top_k(df)) == brute(np.arange(700), x.astype(np.float64))


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, (400, 7)).astype(np.float32)
    df = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES", 11)
    assert rows(topk.top_k(df)) == brute(np.arange(400) * 10, x.astype(np.float64))


def block(x):
    return topk.Rows(np.arange(len(x)), np.asarray(x, float))


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, c = block(rng.integers(-3000, 3000, (5, 64)) / 1024), block(rng.integers(-3000, 3000, (50, 64)) / 1024)
    last = None
    for level in range(3):
        b = c.segments.bounds(level, q.segments, slice(None))
        assert (b >= q.v @ c.v.T).all()
        assert last is None or (b <= last + 1e-3).all()
        last = b


def test_finer_levels_see_survivors_only():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 4)).repeat(16, axis=1)
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 64))
    q, met = topk.Rows(np.arange(8), x[:8]), {}
    got = topk.cell_top(q, block(x), met=met)
    v = np.floor(1024 * x).astype(np.int64)
    want = [(i, j) for i in range(8) for _, j in sorted((-int(v[j] @ v[i]), j) for j in range(4000) if j != i)[:10]]
    assert list(zip(got[0].tolist(), got[1].tolist())) == want
    everything = 8 * 3999
    assert met[0] == everything and met[2] < met[1] < met[0] and met[2] < everything / 2 and met["products"] < everything / 10


def test_products_beyond_64_bits(spark):
    big = [(0, [1e17, 1e17]), (1, [1e17, 1e17]), (2, [1e17, 1.1e17]), (3, [-1e17, 1e17]), (4, [-3e38, 0.0]), (5, [1.0, 2.0]), (100, [1e300, -1e300]), (200, [0.5, 0.25])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got, want = {}, {}
    for r in topk.top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, x in big:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(topk.whole(np.array(x)), topk.whole(np.array(y)))), j) for j, y in big if j != i)
            want[i] = [(r + 1, j, min(max(-v, -(2**63)), 2**63 - 1)) for r, (v, j) in enumerate(s)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_rows_that_take_no_part(spark):
    bad = [(0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0]), (500, [2.0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in bad], "vec_id long, embedding array<float>, id string, d int")
    assert rows(topk.top_k(df)) == {(0, 1, 5, 3 * 1024 * 1024), (500, 1, 6, 2 * 1024 * 1024)}
    assert topk.top_k(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 1, 1024 * 1024), (0, 2, 1, 1024 * 1024)]
