import random

from pyspark.sql import functions as F

from evidex.llm import url_filter as u


def by_definition(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in u.BLOCKED) else "allow"


def test_verdicts_by_definition(spark):
    rng = random.Random(0)
    hosts = ["example.com", "www.example.com", "a.www.Example.COM", "xexample.com", "net", "x.net", "example.org", "casino-win.example.org", "m.casino-win.example.net", "com", "", "..com", "a" * 50 + ".org", "İ.com"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/?a", "/de/#x", "?q=/en/", "#/en/", "/en/a://b"]
    rows = [(i, rng.choice(["http://", "https://", "", "x:/", "://"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "://"), (1002, "://"), (None, "http://net/fr/"), (1003, "http://" + "a." * 5000 + "com/en/")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, key string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in u.judge(df).collect())
    want = sorted((str(i), h, p, r or "", v) for i, x in rows for h, p, r, v in [by_definition(x)])
    assert got == want
    assert u.judge(df.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).cache()
    for every in (2, 7, 400):
        listed = universe.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0)
        c = u.build(universe, listed)
        assert len(c.levels) > 1
        got = {r["key"] for r in universe.filter(c.contains(F.col("key"))).collect()}
        assert got == {r["key"] for r in listed.collect()}
    assert universe.filter(u.build(universe, universe.limit(0)).contains(F.col("key"))).count() == 0
    everything = u.build(universe, universe)
    assert universe.filter(everything.contains(F.col("key"))).count() == 5000


def test_longer_lists_are_exact_too(spark, monkeypatch):
    rows = [(i, f"http://{'m.' * (i % 3)}h{i % 40}.example.{'com' if i % 2 else 'org'}/x") for i in range(400)] + [(1000, None), (1001, "http://h3.example.com")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    listed = [f"h{k}.example.org" for k in range(0, 40, 3)] + ["h5.example.com", "nowhere.example.net"]
    hosts = spark.createDataFrame([(h,) for h in [*listed, listed[0]]], "name string")

    def judged(blocked):
        return sorted(map(tuple, u.judge(df, rules=u.RULES[1:], blocked=blocked).collect()), key=str)

    want = judged(listed)
    assert {v for r in want for v in r[4:5]} == {"allow", "block"} and judged(hosts) == want
    monkeypatch.setattr(u, "MAX_LISTED", 4)
    assert judged(listed) == want and judged(hosts) == want
    assert {r[4] for r in judged([])} == {"allow"}


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "http://net/es/")], "page_id long, url string")
    plan = u.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_words_are_one_literal(spark):
    """The table of bits is folded before the query runs: no row and no hash casts or splits it again."""
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    c = u.build(universe, universe.filter("key % 3 = 0"))
    plan = universe.filter(F.exists(F.array("key"), c.contains))._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan.lower() and not any(x in plan.lower() for x in ("transform(", "split(", "as array<bigint>"))


def test_a_hundred_thousand_listed_keys(spark):
    """A list of that many keys goes into the plan and is exact over all hosts."""
    df = spark.range(200_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".example/x")).alias("url"))
    listed = spark.range(0, 200_000, 2).select(F.concat(F.lit("h"), F.col("id"), F.lit(".example")).alias("host"))
    got = u.judge(df, blocked=listed)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    r = got.groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.col("page_id") % 2).alias("odd")).collect()
    assert {(x["verdict"], x["n"], x["odd"]) for x in r} == {("block", 100_000, 0), ("allow", 100_000, 100_000)}
