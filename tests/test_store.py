import threading

import pytest
from pyspark.sql import functions as F

from evidex.sources import store as st

ROWS = "kb_id string, doc string, chunk string, text string"


@pytest.fixture
def store(spark, tmp_path):
    return st.ChunkStore(spark, str(tmp_path / "store"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def there(df):
    return sorted((r["kb_id"], r["doc"], r["chunk"], r["text"]) for r in df.collect())


def test_versions_of_a_store(spark, store):
    assert there(store.read()) == [] and store.versions() == []
    store.append(frame(spark, ("k", "a", "1", "one"), ("k", "a", "2", "two"), (None, "a", "1", "other"), ("k", "b", "3", "three")))
    assert store.upsert(frame(spark, ("k", "a", "2", "zwei"), ("k", "a", "4", "vier"), ("k", "a", "4", "VIER"))) == 2
    store.delete(spark.createDataFrame([("k", "1"), ("k", "99")], "kb_id string, chunk string"))
    store.delete(spark.createDataFrame([("k", "b")], "kb_id string, doc string"))
    first = [("default", "a", "1", "other"), ("k", "a", "1", "one"), ("k", "a", "2", "two"), ("k", "b", "3", "three")]
    assert there(store.read(1)) == first
    assert there(store.read(2)) == [first[0], first[1], ("k", "a", "2", "zwei"), ("k", "a", "4", "vier"), first[3]]
    assert there(store.read()) == [first[0], ("k", "a", "2", "zwei"), ("k", "a", "4", "vier")]
    assert there(store.read(kb_id="default")) == [first[0]]
    store.replace_documents(frame(spark, ("k", "a", "9", "neun")))
    assert there(store.read()) == [first[0], ("k", "a", "9", "neun")]
    store.restore(spark.createDataFrame([("k", "a"), ("k", "b")], "kb_id string, doc string"), 1)
    assert there(store.read()) == first
    store.delete(spark.createDataFrame([("k",)], "kb_id string"))
    assert there(store.read()) == [first[0]] and there(store.read(1)) == first
    store.append(frame(spark, ("k", "a", "1", "again")))
    assert there(store.read()) == [first[0], ("k", "a", "1", "again")]


def test_new_columns_and_other_types(spark, store):
    store.append(frame(spark, ("k", "a", "1", "x")))
    store.append(frame(spark, ("k", "a", "2", "y")).withColumn("page", F.lit(3)))
    assert {(r["chunk"], r["page"]) for r in store.read().collect()} == {("1", None), ("2", 3)}
    with pytest.raises(ValueError, match="another type"):
        store.append(frame(spark, ("k", "a", "3", "z")).withColumn("page", F.lit("three")))
    assert store.versions() == [1, 2]


def test_base_version_is_checked(spark, store):
    base = store.append(frame(spark, ("k", "a", "1", "x")))
    store.upsert(frame(spark, ("k", "a", "2", "y")), base=base)
    with pytest.raises(st.Conflict):
        store.upsert(frame(spark, ("k", "a", "3", "z")), base=base)
    assert len(there(store.read())) == 2


def test_two_writers_lose_no_rows(spark, store):
    """Writers that commit at the same time, while another compacts: each commit is a version, and no row is lost."""

    def write(i):
        mine = st.ChunkStore(spark, store.path)
        for k in range(3):
            mine.upsert(frame(spark, ("k", f"d{i}", f"{i}-{k}", "v"), ("k", "all", "shared", f"{i}-{k}")))

    store.append(frame(spark, ("k", "d", "0", "v")))
    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    compacted = 0
    while any(t.is_alive() for t in threads):
        try:
            store.compact()
            compacted += 1
        except st.Conflict:
            pass
    for t in threads:
        t.join()
    assert store.versions() == list(range(1, 10 + compacted + 1))
    got = there(store.read())
    assert [r[2] for r in got if r[2] != "shared"] == sorted(["0", *(f"{i}-{k}" for i in range(3) for k in range(3))])
    assert sum(r[2] == "shared" for r in got) == 1


def test_a_lost_race_is_noticed(spark, store, monkeypatch):
    """If another writer's folder is there when ours is renamed, ours is no version, and is tried again on top."""
    store.append(frame(spark, ("k", "a", "1", "x")))
    other = st.ChunkStore(spark, store.path)
    once, publish = [], st.ChunkStore._publish

    def late(self, m):
        if self is store and not once:
            once.append(other.append(frame(spark, ("k", "a", "2", "first"))))
        return publish(self, m)

    monkeypatch.setattr(st.ChunkStore, "_publish", late)
    assert store.append(frame(spark, ("k", "a", "3", "second"))) == 3 and once == [2]
    assert [r[2] for r in there(store.read())] == ["1", "2", "3"]


def test_a_reader_keeps_its_version(spark, store):
    store.append(frame(spark, ("k", "a", "1", "x")))
    seen = store.read()
    store.upsert(frame(spark, ("k", "a", "1", "y")))
    store.compact()
    assert there(seen) == [("k", "a", "1", "x")] and there(store.read()) == [("k", "a", "1", "y")]


def test_compaction_and_vacuum(spark, store, tmp_path):
    for i in range(4):
        store.upsert(frame(spark, ("k", "a", "1", f"v{i}"), ("k", "a", f"c{i}", "x")))
    before = there(store.read())
    store.compact()
    m = store.manifest()
    assert there(store.read()) == before and len(m.segments) == 1 and not m.tombstones
    store.upsert(frame(spark, ("k", "a", "1", "last")))
    assert store.vacuum(2) > 0
    assert len(list((tmp_path / "store" / "rows").glob("segment=*"))) == 2
    assert ("k", "a", "1", "last") in there(store.read()) and len(there(store.read())) == 5
    assert st.ChunkStore(spark, str(tmp_path / "none")).compact() == 0


def test_changes_since_a_version(spark, store):
    v = store.append(frame(spark, ("k", "a", "1", "x"), ("k", "a", "2", "y"), ("k", "b", "3", "z")))
    store.upsert(frame(spark, ("k", "a", "2", "Y")))
    store.delete(spark.createDataFrame([("k", "b")], "kb_id string, doc string"))
    new, gone = store.changed_since(v)
    assert there(new) == [("k", "a", "2", "Y")] and there(gone) == [("k", "a", "2", "y"), ("k", "b", "3", "z")]
    new, gone = store.changed_since(3)
    assert there(new) == [] and there(gone) == []
    store.compact()
    with pytest.raises(st.Conflict):
        store.changed_since(v)


def test_tombstones_by_a_shuffle(spark, store, monkeypatch):
    monkeypatch.setattr(st, "SENT", 0)
    store.append(frame(spark, ("k", "a", "1", "x"), ("k", None, None, "n")))
    store.upsert(frame(spark, ("k", "a", "1", "y")))
    assert {(r["chunk"], r["text"]) for r in store.read().collect()} == {("1", "y"), (None, "n")}
