import json
import threading

import pytest
from pyspark.sql import functions as F

from quizloom.operators import snapshots
from quizloom.operators.snapshots import SnapshotTable
from quizloom.sources.shared import Folder


def rows(spark, *ids, name="n"):
    return spark.createDataFrame([(i, f"{name}{i}", i % 3) for i in ids], "id long, name string, kind int").coalesce(1)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_readers_are_pinned_and_appends_repeat_safely(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        t.read()
    assert t.append(rows(spark, 1, 2), key="a") == 1
    first = t.read()
    assert t.append(rows(spark, 3), key="b") == 2
    assert t.append(rows(spark, 1, 2), key="a") == 1 and t.version() == 2
    assert ids(first) == ids(t.read(1)) == [1, 2] and ids(t.read()) == [1, 2, 3]
    assert t.append(rows(spark, 3)) == 3 and ids(t.read()) == [1, 2, 3, 3]  # without a key it is another append
    with pytest.raises(ValueError, match="other columns"):
        t.append(rows(spark, 4).drop("kind"))


def test_an_append_to_an_empty_table_and_empty_appends(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, 1).limit(0))
    assert ids(t.read()) == []
    t.append(rows(spark, 5))
    assert ids(t.read()) == [5]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", ["_write", "_commit"])
@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("change", ["append", "replace", "delete"])
def test_stopped_between_steps(spark, tmp_path, monkeypatch, step, when, change):
    """Whatever step a change is cut short at, readers see the version before it or after it, whole."""
    t = SnapshotTable(spark, str(tmp_path / "t"), counted=("kind",))
    t.append(rows(spark, *range(6)), key="base")
    calls = {
        "append": lambda: t.append(rows(spark, 7), key="more"),
        "replace": lambda: t.replace(lambda df: df.withColumn("name", F.lit("new")), key="more"),
        "delete": lambda: snapshots.delete(t, spark.createDataFrame([(4,)], "x long"), "id", key="more"),
    }
    inner = getattr(SnapshotTable, step)

    def cut(self, *args):
        if when == "after":
            inner(self, *args)
        raise Stopped

    monkeypatch.setattr(SnapshotTable, step, cut)
    with pytest.raises(Stopped):
        calls[change]()
    monkeypatch.undo()
    done = step == "_commit" and when == "after"
    assert t.version() == 1 + done
    assert ids(t.read(1)) == list(range(6))
    calls[change]()  # repeated under its key: once in all
    assert t.version() == 2
    want = {"append": [0, 1, 2, 3, 4, 5, 7], "replace": [0, 1, 2, 3, 4, 5], "delete": [0, 1, 2, 3, 5]}[change]
    assert ids(t.read()) == want
    assert {r.value: r.n for r in t.counts("kind").collect()} == {r[0]: r[1] for r in t.read().groupBy(F.col("kind").cast("string")).count().collect()}


def test_two_writers(spark, tmp_path):
    """One wins the number, the other works on what the first made."""
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, 1))
    other, seen = SnapshotTable(spark, t.path), []

    def change(df):
        if not seen:
            other.append(rows(spark, 2))
        seen.append(df.count())
        return df.withColumn("name", F.lit("changed"))

    assert t.replace(change) == 3 and seen == [1, 2]
    assert [(r.id, r.name) for r in t.read().orderBy("id").collect()] == [(1, "changed"), (2, "changed")]

    made = [threading.Thread(target=lambda i=i: SnapshotTable(spark, t.path).append(rows(spark, 100 + i), key=f"k{i}")) for i in range(6)]
    for m in made:
        m.start()
    for m in made:
        m.join()
    assert t.version() == 9 and ids(t.read()) == [1, 2, *range(100, 106)]


def test_long_entries_and_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "LONG_EVERY", 4)
    t = SnapshotTable(spark, str(tmp_path / "t"), counted=("kind", "name"))
    for i in range(9):
        t.append(rows(spark, i), key=f"k{i}")
    snapshots.update_where(t, F.col("kind") == 0, name="zero")
    assert len(t.state().keys) == 9 and len(t.state(5).files) == 5 and t.append(rows(spark, 0), key="k0") == 1
    for v in range(1, t.version() + 1):
        for c in t.counted:
            assert {r.value: r.n for r in t.counts(c, v).collect()} == {r[0]: r[1] for r in t.read(v).groupBy(F.col(c).cast("string")).count().collect()}
    assert len(t.state(8).counts) == 1
    with pytest.raises(LookupError):
        t.counts("id")


def test_changes_rewrite_only_the_files_they_touch(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    for part in ([1, 2], [3, 4], [5, 6]):
        t.append(rows(spark, *part))
    before = set(t.state().files)
    assert snapshots.update_where(t, F.col("id") == 3, name="x") == 4
    assert len(before & set(t.state().files)) == 2
    changes = spark.createDataFrame([(5, "filled"), (99, "stray")], "id long, name string")
    snapshots.backfill(t, changes, "id", ["name"], only_blank=False)
    assert len(before & set(t.state().files)) == 1
    assert {r.id: r.name for r in t.read().collect()} == {1: "n1", 2: "n2", 3: "x", 4: "n4", 5: "filled", 6: "n6"}
    assert snapshots.delete(t, spark.createDataFrame([(77,)], "i long"), "id") == t.version()  # touches nothing, makes no version


def test_find_or_insert_twice_and_by_two(spark, tmp_path, monkeypatch):
    users = SnapshotTable(spark, str(tmp_path / "u"))
    make = lambda *r: spark.createDataFrame(list(r), "google_id string, email string")
    version, rejected = snapshots.find_or_insert(users, make(("a", "1"), ("a", "0"), ("b", ""), (None, "x")))
    assert version == 1 and rejected.count() == 2
    commit, others = SnapshotTable._commit, [make(("c", "first"))]

    def slower(self, *args):
        if others:
            SnapshotTable(spark, users.path).append(others.pop())
        return commit(self, *args)

    monkeypatch.setattr(SnapshotTable, "_commit", slower)
    snapshots.find_or_insert(users, make(("c", "second"), ("d", "4")))
    assert sorted((r.google_id, r.email) for r in users.read().collect()) == [("a", "0"), ("c", "first"), ("d", "4")]


def test_cascade_and_vacuum(spark, tmp_path):
    tables = {n: SnapshotTable(spark, str(tmp_path / n)) for n in ("quizzes", "questions", "attempts")}
    tables["quizzes"].append(rows(spark, 1, 2, 3))
    for n in ("questions", "attempts"):
        tables[n].append(spark.createDataFrame([(10, 1), (11, 2), (12, 2)], "id long, quiz_id long"))
    gone = spark.createDataFrame([(2,)], "id long")
    snapshots.cascade_delete(gone, **tables)
    snapshots.cascade_delete(gone, **tables)
    assert [ids(tables[n].read()) for n in tables] == [[1, 3], [10], [10]]
    t = tables["quizzes"]
    assert t.vacuum() == [] and len(t.vacuum(hours=0)) == 1
    assert ids(t.read()) == [1, 3]


def test_put_if_absent(spark, tmp_path):
    f = Folder(spark, str(tmp_path))
    assert f.names("log") == [] and f.put_if_absent("log/1.json", json.dumps({"ü": 1})) and not f.put_if_absent("log/1.json", "other")
    assert json.loads(f.read("log/1.json")) == {"ü": 1} and f.names("log") == ["1.json"]
