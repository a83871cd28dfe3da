import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidex.operators import metrics, ops

RECORD = "entity string, period_year int, period_type string, scope string, metric string, value decimal(20,6), status string, updated_at string, id long"


def record(entity, year, value, metric="revenue", scope="consolidated", status="ok", updated="1", ident=1, kind="annual"):
    return entity, year, kind, scope, metric, None if value is None else Decimal(value), status, updated, ident


def test_year_over_year(spark):
    rows = [record("a", 2023, 100), record("a", 2024, 150), record("a", 2024, 120, updated="2", ident=2), record("b", 2023, 0), record("b", 2024, 5), record("c", 2023, -10), record("c", 2024, 5, scope="parent"), record("d", 2023, -40), record("d", 2024, 10)]
    got = {(r["entity"], r["period_year"]): r for r in metrics.compared(spark.createDataFrame(rows, RECORD)).collect()}
    assert (got["a", 2024]["change_amount"], got["a", 2024]["change_rate"]) == (Decimal(20), Decimal("20.00"))
    assert got["b", 2024]["change_rate"] is None and got["b", 2024]["note"] == "the comparison value is zero"
    assert got["c", 2024]["note"] == "scopes differ" and not got["c", 2024]["comparable"]
    assert got["d", 2024]["change_rate"] == Decimal("125.00") and got["a", 2023]["note"] == "no comparison record"


def test_peers(spark):
    rows = [record("a", 2024, 50), record("b", 2024, -100), record("a", 2024, 0, "total_assets"), record("b", 2024, 0, "total_assets"), record("a", 2024, 1, "net_profit_parent"), record("b", 2024, 1, "net_profit_parent", status="conflict")]
    groups = spark.createDataFrame([(1, "a"), (1, "b")], "grp int, entity string")
    got = {(r["metric"], r["entity"]): r for r in metrics.peers(spark.createDataFrame(rows, RECORD), groups).collect()}
    assert got["revenue", "a"]["bar_percent"] == Decimal("50.00") and got["revenue", "b"]["bar_percent"] == Decimal("100.00") and got["revenue", "a"]["leader"]
    assert got["total_assets", "a"]["bar_percent"] == 0 and got["total_assets", "b"]["leader"]
    assert got["net_profit_parent", "a"]["note"] == "conflict" and got["operating_cash_flow", "a"]["note"] == "missing"
    codes = {(r["metric"], r["code"]) for r in metrics.findings(spark.createDataFrame(rows, RECORD)).collect() if r["entity"] == "a"}
    assert ("operating_cash_flow", "missing_current_metric") in codes and ("revenue", "missing_comparison_metric") in codes


def test_patches_and_seeds(spark):
    stored = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    new, changes = metrics.patched(stored, spark.createDataFrame([(2, None, 3.0)], "id int, name string, v double"))
    assert sorted(map(tuple, new.collect())) == [(1, "a", 1.0), (2, "b", 3.0)] and [r["id"] for r in changes.collect()] == [2]
    seeded = metrics.seeded(stored.select("id", "name"), spark.createDataFrame([(1, "z"), (3, "c")], "id int, name string"), ("id",))
    assert sorted(map(tuple, seeded.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_alerts(spark):
    stored = spark.createDataFrame([("a", "low", "resolved"), ("b", "low", "acknowledged"), ("x", "low", "open")], "key string, severity string, status string")
    emitted = spark.createDataFrame([("a", "high"), ("b", "high"), ("c", "high")], "key string, severity string")
    assert sorted(map(tuple, ops.alerts_after(stored, emitted).collect())) == [("a", "high", "open"), ("b", "high", "acknowledged"), ("c", "high", "open"), ("x", "low", "open")]
    assert {r["key"]: r["status"] for r in ops.resolved_missing(stored, "x", emitted).collect()}["x"] == "resolved"


def test_sliding_window_limit_counts_admitted_only(spark):
    t0 = dt.datetime(2024, 1, 1)
    times = [0, 10, 20, 59, 61, 62, 75, 130]
    df = spark.createDataFrame([(i, u, t0 + dt.timedelta(seconds=s)) for u in (1, 2) for i, s in enumerate(times)], "event_id long, user_id long, ts timestamp")
    seen, want = [], []
    for s in times:
        seen = [x for x in seen if x > s - 60]
        want.append(len(seen) < 2)
        if want[-1]:
            seen.append(s)
    rows = ops.admitted(df, 2, 60).collect()
    for u in (1, 2):
        assert [r["admitted"] for r in sorted(rows, key=lambda r: r["event_id"]) if r["user_id"] == u] == want


def test_versions_history_and_retention(spark):
    v = spark.createDataFrame([("d", "a", 1), ("d", "b", 2), ("e", "c", 1)], "doc_id string, snap string, version_no int")
    assert ("d", "a", 3) in {tuple(r) for r in ops.rolled_back(v, "d", 1).collect()}
    turns = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(["user", "agent", "user"])], "conv_id int, turn int, role string, text string")
    assert [(r["turn"], r["role"]) for r in ops.history(turns, 2).orderBy("turn").collect()] == [(1, "assistant"), (2, "user")]
    rows = spark.createDataFrame([(1, "closed", "2023-01-01"), (2, "open", "2023-01-01"), (3, "closed", "2024-05-01"), (4, "closed", None)], "id int, status string, at string").withColumn("at", F.to_timestamp("at"))
    assert [r["id"] for r in ops.kept(rows, "at", 365, "2024-06-01", F.col("status") == "closed").orderBy("id").collect()] == [2, 3, 4]


def test_transitions_and_queues(spark):
    moves = spark.createDataFrame([("draft", "review"), ("draft", "published"), (None, "review")], "from_state string, to_state string")
    assert [r["legal"] for r in ops.transitions(moves, ops.DOCUMENT_STATES).collect()] == [True, False, False]
    agents = spark.createDataFrame([("g", "a", True, 0), ("g", "b", True, 1), ("g", "c", False, 2)], "grp string, agent string, available boolean, ord int")
    busy = spark.createDataFrame([("a",), ("a",), ("b",)], "agent string")
    assert tuple(ops.least_loaded(agents, busy).first()) == ("g", "b", 1)
    assert ops.least_loaded(agents, busy.limit(0)).first()["agent"] == "a"
    sources = spark.createDataFrame([(1, True, "2024-01-01", None), (2, True, "2024-01-03", None), (3, False, "2024-01-01", None), (4, True, "2024-01-01", "2024-02-01")], "id int, enabled boolean, next_sync_at string, lease_until string")
    sources = sources.withColumn("next_sync_at", F.to_timestamp("next_sync_at")).withColumn("lease_until", F.to_timestamp("lease_until"))
    assert [r["id"] for r in ops.leased(sources, "2024-01-02", 5, 10).collect()] == [1]


def test_limit_in_parts_equals_one_pass(spark):
    """A user with a third of all events, in many parts; gaps, dense stretches over several parts, equal times, null users and times."""
    rng = random.Random(0)
    events, n = [], 0
    for user, count in ((1, 400), (2, 120), (None, 60), (3, 300), (4, 1)):
        t = 0
        for i in range(count):
            # user 1 never pauses for the window's length; others do
            t += rng.choice([0, 1, 5, 20]) if user == 1 or i % 40 else 100
            events.append((n, user, t))
            n += 1
    rng.shuffle(events)
    df = spark.createDataFrame(events, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.lit("x").alias("note"))
    df = df.unionByName(df.limit(2).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("event_id", F.col("event_id") + 100_000))
    want, seen = {}, {}
    for i, user, t in sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[2], e[0])):
        own = [x for x in seen.get(user, []) if x > t - 60]
        want[i] = len(own) < 3
        seen[user] = own + [t] * want[i]
    for size in (90, 100_000):
        got = {r["event_id"]: r["admitted"] for r in ops.admitted(df, 3, 60, part_rows=size).collect()}
        assert {i: x for i, x in got.items() if i < 100_000} == want
        assert [x for i, x in got.items() if i >= 100_000] == [False, False]
    assert set(ops.admitted(df, 0, 60, part_rows=50).select("admitted").distinct().collect()) == {(False,)}
    assert ops.admitted(df.limit(0), 3, 60).count() == 0


def test_percentiles_by_rank(spark):
    """One group with most rows, ties, wide and narrow values, a null group; against sorted lists, however early histograms end."""
    rng = random.Random(1)
    data = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("hot", 7.0)] * 800 + [("wide", s * 10.0 ** rng.randint(-300, 300)) for s in (-1, 1) for _ in range(150)] + [(None, float(i % 3)) for i in range(50)]
    data += [("one", 5.0), ("max", 1.7e308), ("max", -1.7e308), ("gone", None), ("hot", float("nan")), ("hot", float("inf"))]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    groups = {}
    for g, v in data:
        if v is not None and math.isfinite(v):
            groups.setdefault(g, []).append(v)
    for floor in (True, False):
        want = {}
        for g, values in groups.items():
            values.sort()
            n = len(values)
            ranks = [min(n - 1, math.floor(n * p)) if floor else max(0, math.ceil(n * p) - 1) for p in wanted.values()]
            want[g] = (n, *(values[r] for r in ranks))
        for few in (60, 100_000):
            assert {r["g"]: (r["n"], *(r[c] for c in wanted)) for r in ops.percentiles(df, ["g"], "v", wanted, floor, few).collect()} == want
    assert ops.percentiles(df.limit(0), ["g"], "v", wanted).count() == 0


@pytest.mark.parametrize("p, want", [(0.5, 3), (0.95, 4), (0.0, 1)])
def test_percentile_by_floor(spark, p, want):
    df = spark.createDataFrame([(x,) for x in (4, 2, 1, 3)], "x int")
    assert ops.percentiles(df, [], "x", {"p": p}).first()["p"] == want


def test_a_revision_keeps_the_sign_of_zero_and_zero_alone_is_none(spark, tmp_path):
    from evidex.plans import metric_queries

    rows = [(1, "a", -0.3), (2, "a", -0.5), (3, "a", 0.3), (4, "a", 7.0), (5, "a", -0.0), (6, None, None), (7, "b", -2.5)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["id"]: str(r["new_bal"]) for r in metric_queries.metric_revisions(spark, str(tmp_path)).collect()}
    assert got == {1: "-0.0", 2: "-1.0", 3: "0.0", 7: "-3.0"}
    stored = spark.createDataFrame([(1, 0.0)], "id int, v double")
    assert metrics.patched(stored, spark.createDataFrame([(1, -0.0)], "id int, v double"))[1].count() == 0
