import itertools

import pytest

from evidex.functions import filters

ROWS = [(1, 3, "a", True), (2, None, "b", False), (3, 7, None, None), (4, 5, "a", True)]


def matches(meta, where):
    """The dialect by plain Python, where a missing field is None."""
    for key, cond in (where or {}).items():
        if key == "$and":
            ok = all(matches(meta, w) for w in cond)
        elif key == "$or":
            ok = any(matches(meta, w) for w in cond)
        elif key == "$not":
            ok = not matches(meta, cond)
        else:
            a, ok = meta.get(key), True
            for op, v in (cond if isinstance(cond, dict) else {"$eq": cond}).items():
                if op in ("$eq", "$ne"):
                    ok &= (a == v) == (op == "$eq")
                elif op in ("$in", "$nin"):
                    ok &= (a in v) == (op == "$in")
                else:
                    try:
                        ok &= a is not None and {"$gt": lambda: a > v, "$gte": lambda: a >= v, "$lt": lambda: a < v, "$lte": lambda: a <= v}[op]()
                    except (TypeError, KeyError):
                        ok = False
        if not ok:
            return False
    return True


ATOMS = [
    {"n": 3}, {"n": {"$ne": 3}}, {"n": {"$gt": 3}}, {"n": {"$gte": 3, "$lt": 7}}, {"n": {"$in": [3, 5]}}, {"n": {"$nin": [3, 5]}}, {"n": {"$nin": [None]}}, {"n": None}, {"s": "a"}, {"s": {"$ne": "a"}},
    {"s": {"$gt": "a"}}, {"n": {"$gt": "a"}}, {"s": {"$lte": 3}}, {"missing": {"$ne": 1}}, {"missing": 1}, {"missing": {"$nin": [1]}}, {"n": {"$like": 3}}, {"b": True}, {"s": {"$in": []}}, {"s": {"$nin": []}},
]


def test_truth_table(spark):
    df = spark.createDataFrame(ROWS, "id long, n long, s string, b boolean")
    wheres = [None, {}, *ATOMS, *[{"$not": a} for a in ATOMS], {"$and": []}, {"$or": []}]
    wheres += [{op: [a, b]} for a, b in itertools.combinations(ATOMS[::3], 2) for op in ("$and", "$or")]
    for where in wheres:
        got = [r["id"] for r in filters.where(df, where).orderBy("id").collect()]
        assert got == [r[0] for r in ROWS if matches(dict(zip("nsb", r[1:])) | {"n": r[1]}, where)], where


def test_isolation_and_whitelist(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "default")], "id long, kb_id string")
    assert [r["id"] for r in filters.where(df, None, "default").orderBy("id").collect()] == [2, 3]
    assert filters.checked({"$and": [{"page": 1}, {"$not": {"unit": "元"}}]})
    for bad in ({"kb_id": "x"}, {"$or": [{"text": "a"}]}, {"page": "x" * 5000}):
        with pytest.raises(ValueError):
            filters.checked(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id long, n long, s string, b boolean").write.parquet(str(tmp_path / "t"))
    plan = filters.where(spark.read.parquet(str(tmp_path / "t")), {"n": {"$gt": 3}, "s": "a"})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(n,3)" in plan
