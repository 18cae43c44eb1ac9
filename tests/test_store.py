"""Stored collections, merges across batches, snapshots, streams."""

import pytest

from spindrift.sources import collection as C
from spindrift.streaming import ingest

SCHEMA = "id long, vector array<double>, at long"


@pytest.fixture
def store(spark, tmp_path):
    return C.Store(spark, f"{tmp_path}/store")


def held(df):
    return sorted((r.id, r.vector[0]) for r in df.collect())


@pytest.mark.parametrize("layout", [{}, {"key": "id", "buckets": 4}])
def test_last_write_wins_across_batches(spark, store, tmp_path, layout):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store.create("c", frame([(1, [1.0], 1), (2, [2.0], 5)]), 1, **layout)
    for k, rows in enumerate(([(2, [9.0], 7), (2, [8.0], 6), (3, [3.0], 1)], [(2, [0.0], 6), (3, [4.0], 2), (1, [0.5], 0)])):
        frame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), store, "c", "id", "at", f"{tmp_path}/check").awaitTermination()
        assert held(store.read("c")) == [[(1, 1.0), (2, 9.0), (3, 3.0)], [(1, 1.0), (2, 9.0), (3, 4.0)]][k]
    version = store.version("c")
    assert store.merge("c", frame([(1, [7.0], 99)]), "at", "id", batch=1) == version  # a replay
    assert held(store.read("c", 1)) == [(1, 1.0), (2, 2.0)] and store.total() == 3


def test_merges_touch_their_buckets_only(spark, store):
    store.create("c", spark.createDataFrame([(i, [float(i)], 0) for i in range(100)], SCHEMA), 1, key="id", buckets=16)
    store.merge("c", spark.createDataFrame([(5, [-1.0], 1), (200, [2.0], 1)], SCHEMA), "at")
    entry = store._rows_entry(store._live("c"))
    places = C.json.loads(entry["places"])
    assert sum(v == 2 for v in places.values()) <= 2 and entry["rows"] == 101 == store.read("c").count()
    assert dict(held(store.read("c")))[5] == -1.0
    assert store.vacuum("c") == []  # most buckets still are in the first version
    assert store.compact("c") == 3 and store.vacuum("c") == [1, 2] and store.read("c").count() == 101
    store.merge("c", spark.createDataFrame([], SCHEMA), "at")
    assert store.version("c") == 3


def test_created_stays_and_bad_rows_are_split(spark):
    old = spark.createDataFrame([(1, [1.0], 10)], "id long, vector array<double>, created long")
    new = spark.createDataFrame([(1, [2.0], 99), (2, [3.0], 50), (3, [1.0, 2.0], 50), (4, None, 1)], old.schema)
    merged, bad = C.upsert_valid(old, new, "id", 1, created="created")
    assert sorted(map(tuple, merged.collect())) == [(1, [2.0], 10), (2, [3.0], 50)]
    assert sorted(r.id for r in bad.collect()) == [3, 4]


def test_names_settings_and_creation_after_drop(spark, store):
    rows = spark.createDataFrame([(1, [1.0], 1)], SCHEMA)
    assert store.list() == []
    with pytest.raises(KeyError):
        store.version("b")
    store.create("b", rows, 1, description="first")
    store.create("a", rows, 1, "dot")
    assert store.list() == ["a", "b"]
    with pytest.raises(ValueError):
        store.create("b", rows, 1)
    store.write("b", rows.union(rows.selectExpr("2L", "vector", "at")))
    store.describe("b", "second")
    assert store.settings("b")["description"] == "second" and store.version("b") == 2 and store.read("b").count() == 2
    store.drop("b")
    assert store.list() == ["a"] and not store.exists("b")
    with pytest.raises(KeyError):
        store.read("b")
    store.create("b", rows, 3, "l2")
    assert store.version("b") == 3 and store.read("b").count() == 1
    assert store.settings("b")["metric"] == "l2" and store.settings("b")["description"] == ""
    assert [tuple(r) for r in store.stats().orderBy("collection").collect()] == [("a", 1), ("b", 1)]


def test_missing_rows_are_no_missing_collection(spark, store, tmp_path):
    store.create("c", spark.createDataFrame([(1, [1.0], 1)], SCHEMA), 1)
    import shutil

    shutil.rmtree(f"{tmp_path}/store/c/v1")
    assert store.exists("c")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read("c")


def test_snapshots(spark, store, tmp_path):
    store.create("c", spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1), (2, [2.0], 1)], SCHEMA), 1, "dot")
    store.snapshot("c", f"{tmp_path}/snaps/one")
    store.write("c", C.delete_by_filter(store.read("c"), {"id": {"$gt": 1}}))
    store.snapshot("c", f"{tmp_path}/snaps/two")
    assert [(r["name"], r["rows"]) for r in store.snapshots(f"{tmp_path}/snaps").collect()] == [("c", 1), ("c", 3)]
    assert store.snapshots(f"{tmp_path}/snaps").first()["path"].endswith("snaps/two")
    assert store.verify(f"{tmp_path}/snaps/one")
    store.restore(f"{tmp_path}/snaps/one", "c")
    assert store.read("c").count() == 3
    store.restore(f"{tmp_path}/snaps/one", "d")
    assert store.settings("d")["metric"] == "dot" and store.read("d").count() == 3
    spark.createDataFrame([(1, [1.5], 1)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/snaps/one/rows")
    with pytest.raises(ValueError):
        store.restore(f"{tmp_path}/snaps/one", "e")


def test_fingerprints_follow_the_content(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "id long, t string, x double")
    print_ = lambda df: tuple(C.fingerprint(df).first())
    assert print_(rows) == print_(rows.repartition(3).select("x", "t", "id"))
    assert len({print_(rows), print_(rows.limit(0)), print_(rows.fillna(0.0)), print_(rows.union(rows))}) == 4
