"""Keyed tables: first writes, updates, sets, deletes, reruns, failures between write and commit, two writers."""

import pytest
from pyspark.sql import functions as F

from flockscope.sources.keyed import Conflict, KeyedTable, retried


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_write_wins(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["a", "b"], 4)
    assert t.read() is None and t.versions() == []
    one = spark.createDataFrame([(1, "x", 5, "late"), (1, "x", 2, "first"), (2, "y", 1, None), (None, "z", 0, "no key")], "a long, b string, at int, v string")
    assert t.insert_absent(one, ["at"]) == 1
    want = [(1, "x", 2, "first"), (2, "y", 1, None)]
    assert rows(t.read(), "a", "b", "at", "v") == want
    t.insert_absent(one, ["at"])  # again: the same table
    two = spark.createDataFrame([(2, "y", 0, "later write"), (3, "q", 7, "new")], "a long, b string, at int, v string")
    t.insert_absent(two, ["at"])
    assert rows(t.read(), "a", "b", "at", "v") == [*want, (3, "q", 7, "new")] and rows(t.read(1), "a", "b", "at", "v") == want
    assert t.insert_absent(two.limit(0), ["at"]) is None and t.versions() == [1, 2, 3]


def test_updates_field_by_field(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 8)
    t.upsert(spark.createDataFrame([(i, 1, f"n{i}", 0) for i in range(40)], "id long, at int, name string, score int"), ["at"])
    before = dict(t._manifest()["files"])
    patch = spark.createDataFrame([(3, 2, 7, "seen"), (3, 3, None, "done"), (99, 1, 1, "new")], "id long, at int, score int, state string")
    t.upsert(patch, ["at"])
    got = {r.id: (r.at, r.name, r.score, r.state) for r in t.read().collect()}
    assert got[3] == (3, "n3", 7, "done") and got[99] == (1, None, 1, "new") and got[4] == (1, "n4", 0, None) and len(got) == 41
    after = t._manifest()["files"]
    assert 1 <= sum(before.get(b) != p for b, p in after.items()) <= 2  # only touched buckets are written anew
    t.upsert(patch, ["at"])
    assert {r.id: (r.at, r.name, r.score, r.state) for r in t.read().collect()} == got


def test_sets_and_counters(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["media"], 2)
    use = spark.createDataFrame([("m", 1, "x"), ("m", 2, "x"), ("m", 1, "y"), ("k", 9, None)], "media string, post long, platform string")
    t.accumulate(use, ["post", "platform"], "seen")
    t.accumulate(spark.createDataFrame([("m", 3, "x"), ("z", 1, "q")], "media string, post long, platform string"), ["post", "platform"], "seen")
    assert rows(t.read(), "media", "post", "platform", "seen") == [("k", [9], [], 1), ("m", [1, 2, 3], ["x", "y"], 4), ("z", [1], ["q"], 1)]


def test_deletes(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 4)
    t.insert_absent(spark.range(100).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("id") % 2)), [])
    assert t.delete(F.col("v") == 1) == 2 and rows(t.read(), "id") == [(i,) for i in range(100) if i % 10 == 0 or i % 2 == 0]
    assert t.delete(F.col("v") == 1) is None
    t.delete(F.lit(True))
    assert t.read().count() == 0
    t.insert_absent(spark.range(3).withColumn("v", F.lit(None).cast("long")), [])
    assert t.read().count() == 3 and t.vacuum(1) > 0 and t.versions() == [4] and t.read().count() == 3


def test_a_failure_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 4)
    t.insert_absent(spark.range(10).withColumn("v", F.lit("a")), [])
    more = spark.range(5, 20).withColumn("v", F.lit("b"))

    def crash(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", crash)
        with pytest.raises(OSError, match="lost"):
            t.upsert(more, [])
    assert rows(t.read(), "id", "v") == [(i, "a") for i in range(10)] and t.versions() == [1]
    t.upsert(more, [])
    assert rows(t.read(), "id", "v") == [(i, "a" if i < 5 else "b") for i in range(20)]
    t.vacuum(1)
    assert t.read().count() == 20


def test_of_two_writers_one_begins_again(spark, tmp_path, monkeypatch):
    t, other = (KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 1) for _ in range(2))
    t.insert_absent(spark.range(1), [])
    commit, turns = KeyedTable._commit, []

    def late(self, manifest):
        if self is t and not turns:
            turns.append(1)
            other.insert_absent(spark.range(5, 6), [])
        commit(self, manifest)

    monkeypatch.setattr(KeyedTable, "_commit", late)
    with pytest.raises(Conflict):
        t.insert_absent(spark.range(9, 10), [])
    turns.clear()
    retried(lambda: t.insert_absent(spark.range(9, 10), []))
    assert rows(t.read(), "id") == [(0,), (5,), (9,)]
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable(spark, t.path, ["id"], 2).insert_absent(spark.range(1), [])
