"""Keyed tables on disk: snapshots, copy on write."""

import os

import pytest
from pyspark.sql import functions as F

from opinionlake.operators import tables

SCHEMA = "email string, password string, username string"


def folder_files(path):
    return {
        os.path.relpath(os.path.join(at, f), path) for at, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")
    }


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "users")
    rows = [(f"u{i}@x", f"p{i}", f"n{i}") for i in range(200)]
    tables.create(spark, where, spark.createDataFrame([*rows, (None, "p", "n")], SCHEMA), "email", buckets=20)
    return where


def changes(spark, rows):
    return spark.createDataFrame(rows, "seq long, email string, password string, username string")


def held(spark, path, version=None):
    return {r.email: (r.password, r.username) for r in tables.read(spark, path, version).collect()}


def test_a_user_is_changed_and_read_back(spark, path):
    before = held(spark, path)
    assert len(before) == 200
    tables.upsert(spark, path, changes(spark, [(1, "u7@x", "old", "a"), (3, "u7@x", "new", "b"), (2, "new@x", "pw", "c"), (4, None, "x", "y")]), "seq")
    after = held(spark, path)
    assert after == before | {"u7@x": ("new", "b"), "new@x": ("pw", "c")}
    tables.update(spark, path, changes(spark, [(5, "u8@x", None, "z"), (6, "absent@x", "pw", "z")]), "seq", ["password"])
    assert held(spark, path) == after | {"u8@x": (None, "n8")}
    tables.delete(spark, path, changes(spark, [(7, "u9@x", None, None), (8, "absent@x", None, None), (9, None, None, None)]))
    assert "u9@x" not in held(spark, path) and len(held(spark, path)) == 200
    assert [r.email for r in tables.find(spark, path, changes(spark, [(1, "u7@x", "", ""), (2, "u9@x", "", "")])).collect()] == ["u7@x"]


def test_other_buckets_keep_their_files(spark, path):
    first = tables.snapshot(spark, path)
    files = folder_files(path)
    made = tables.upsert(spark, path, changes(spark, [(1, "u7@x", "new", "b")]), "seq")
    changed = [b for b in first.folders if made.folders[b] != first.folders[b]]
    assert len(changed) == 1 and len(first.folders) > 15 and files < folder_files(path)
    assert len(folder_files(path) - files) == 1


def test_readers_of_an_older_snapshot_are_safe(spark, path):
    reader, before = tables.read(spark, path), held(spark, path)
    tables.delete(spark, path, reader.where("email < 'u2'"))
    assert {r.email: (r.password, r.username) for r in reader.collect()} == before == held(spark, path, 0)
    assert len(held(spark, path)) < len(before)
    assert tables.versions(spark, path) == [0, 1]
    gone = tables.vacuum(spark, path)
    assert gone > 0 and tables.versions(spark, path) == [1] and len(held(spark, path)) < len(before)
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path, 0)


def test_of_two_writers_one_wins(spark, path, monkeypatch):
    stale = tables.snapshot(spark, path)
    tables.upsert(spark, path, changes(spark, [(1, "u7@x", "first", "b")]), "seq")
    monkeypatch.setattr(tables, "snapshot", lambda *a: stale)
    with pytest.raises(tables.ConcurrentChange):
        tables.upsert(spark, path, changes(spark, [(1, "u7@x", "second", "b")]), "seq")
    monkeypatch.undo()
    assert held(spark, path)["u7@x"] == ("first", "b") and tables.versions(spark, path) == [0, 1]
    # What the other one wrote is in no snapshot.
    assert tables.vacuum(spark, path, keep=2) >= 1 and len(held(spark, path)) == 200


def test_empty_buckets_tables_and_changes(spark, path, tmp_path):
    tables.delete(spark, path, tables.read(spark, path))
    assert held(spark, path) == {} and tables.snapshot(spark, path).folders == {}
    nothing = changes(spark, [])
    assert tables.upsert(spark, path, nothing, "seq").version == 1
    tables.upsert(spark, path, changes(spark, [(1, "a@x", "p", "n")]), "seq")
    assert held(spark, path) == {"a@x": ("p", "n")}
    other = str(tmp_path / "none")
    assert tables.versions(spark, other) == [] and tables.vacuum(spark, other) == 0
    tables.create(spark, other, tables.read(spark, path).where(F.lit(False)), "email")
    assert tables.read(spark, other).count() == 0
