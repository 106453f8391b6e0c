import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from opinionlake.operators import keyed as K
from opinionlake.operators import ranking as R
from opinionlake.plans import pipeline
from opinionlake.sources import files
from opinionlake.sources.samples import raw_reviews

AS_OF = dt.datetime(2026, 1, 1)
RAW = "review_seq long, site string, rating string, date string, content string"
USERS = "email string, password string, username string"
CHANGES = "seq long, email string, password string, username string"


def sha(*parts):
    return hashlib.sha256("||".join(parts).encode()).hexdigest()


def test_content_keys(spark):
    rows = spark.createDataFrame(
        [(1, "kyobo", "5", "2024-01-01", "책|좋은"), (2, "kyobo", "5.0", "2024-01-01", "책|좋은"), (3, "kyobo", "n/a", None, "x")],
        RAW,
    )
    got = [r.raw_id for r in K.with_raw_id(rows).orderBy("review_seq").collect()]
    first = sha("kyobo", "2024-01-01", "5.0", "책|좋은")
    assert got == [first, first, sha("kyobo", "nan", "nan", "x")]


def test_first_copy_wins_and_known_keys_stay(spark):
    target = spark.createDataFrame([("a", 1, "old")], "k string, seq int, v string")
    batch = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("b", 3, "first")], "k string, seq int, v string")
    got = sorted(tuple(r) for r in K.insert_only_merge(target, batch, "k", "seq").collect())
    assert got == [("a", 1, "old"), ("b", 3, "first")]
    stats = K.merge_stats(target, batch.withColumn("site", F.lit("s")), "k").first()
    assert (stats.batch_rows, stats.inserted, stats.matched) == (3, 1, 2)


def test_insert_only_rerun_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("a", "s", 1), ("a", "s", 2), ("b", "s", 3)], "k string, site string, seq int")
    assert K.insert_only(spark, path, batch, "k", "seq", "r1") == {"total": 3, "inserted": 2, "matched": 1}
    assert K.insert_only(spark, path, batch, "k", "seq", "r2") == {"total": 3, "inserted": 0, "matched": 3}
    # The same run again, as after a crash: nothing doubles.
    K.append_new(spark, path, batch, "k", "seq", "r1")
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == [1, 3]


def test_hot_key(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    assert R.first_by(rows, ["k"], [F.col("id")]).count() == 20001
    got = R.head_per(rows.withColumn("k", F.lit("all")), ["k"], ["id"], 700)
    assert sorted((r.id, r.position) for r in got.collect()) == [(i, i + 1) for i in range(700)]


def test_fill_from(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1), ("x", 3)], "k string, seq int")
    b = spark.createDataFrame([("y", 0), ("z", 5), ("w", 4)], "k string, seq int")
    got = [(r.k, r.seq) for r in R.fill_from(a, b, F.col("k"), "seq", 3).collect()]
    assert got == [("y", 1), ("x", 2), ("w", 4)]


@pytest.fixture()
def store(spark, tmp_path):
    raw = str(tmp_path / "raw")
    rows = pipeline.seed(raw_reviews(spark, "/root/testdata/sf0.001"))
    files.save(rows, raw)
    return raw


@pytest.mark.parametrize("sites", ["aladin", ("kyobo", "yes24")])
def test_a_rerun_inserts_nothing(spark, store, tmp_path, sites):
    out = str(tmp_path / "out")
    first = pipeline.run_incremental(spark, store, out, sites, AS_OF, "r1").collect()
    for r in first:
        assert r.raw_count == r.to_process_count > r.processed_rows >= r.inserted_new > 0
    table = spark.read.parquet(f"{out}/documents")
    assert table.count() == sum(r.inserted_new for r in first) == table.select("processed_id").distinct().count()
    assert {"tfidf", "tfidf_sum", "year_month", "raw_id"} <= set(table.columns)
    ledger = spark.read.parquet(f"{out}/ledger")
    assert ledger.count() == sum(r.raw_count for r in first)
    assert ledger.where("outcome = 'kept'").count() == sum(r.processed_rows for r in first)
    for run in ("r2", "r3"):
        again = pipeline.run_incremental(spark, store, out, sites, AS_OF, run).collect()
        assert len(again) == len(first)
        assert [(r.to_process_count, r.processed_rows, r.inserted_new) for r in again] == [(0, 0, 0)] * len(first)
    assert spark.read.parquet(f"{out}/documents").count() == table.count()


def test_a_broken_off_run_is_completed(spark, store, tmp_path):
    whole, torn = str(tmp_path / "whole"), str(tmp_path / "torn")
    pipeline.run_incremental(spark, store, whole, "yes24", AS_OF, "r1")
    # Only some documents were written, and no ledger.
    some = spark.read.parquet(f"{whole}/documents").where("review_seq % 3 = 0")
    some.write.partitionBy("site", "run").parquet(f"{torn}/documents")
    pipeline.run_incremental(spark, store, torn, "yes24", AS_OF, "r1")
    shown = lambda path: sorted(
        (r.processed_id, round(r.tfidf_sum, 9), r.run) for r in spark.read.parquet(f"{path}/documents").collect()
    )
    assert shown(torn) == shown(whole)


def test_head_per_above_a_thousand(spark):
    rows = spark.range(20_000).select(F.lit("all").alias("k"), (F.col("id") * 7919 % 20_011).alias("id"))
    ids = sorted(r.id for r in rows.collect())
    for n in (1001, 5000):
        got = sorted((r.position, r.id) for r in R.head_per(rows, ["k"], ["id"], n).collect())
        assert got == [(i + 1, v) for i, v in enumerate(ids[:n])]


def test_run_all_writes_every_site(spark, tmp_path):
    out = pipeline.run_all(raw_reviews(spark, "/root/testdata/sf0.001"), str(tmp_path / "all"), AS_OF)
    counts = {r.site: r["count"] for r in out.groupBy("site").count().collect()}
    assert set(counts) == {"aladin", "kyobo", "yes24"} and min(counts.values()) > 0


# --- users --------------------------------------------------------------------


@pytest.fixture()
def users(spark):
    rows = [
        ("ada@mail.test", "violet-9", "ada"),
        ("ben@mail.test", "maple-4", "ben"),
        ("cleo@mail.test", "birch-1", "cleo"),
        ("dina@mail.test", "cedar-7", "dina"),
    ]
    return spark.createDataFrame(rows, USERS)


def statuses(df):
    return {r.email: r.status for r in df.collect()}


def test_lookup(users):
    assert tuple(K.get_by_key(users, "email", "ben@mail.test").first()) == (
        "ben@mail.test", "maple-4", "ben"
    )
    assert K.get_by_key(users, "email", "nobody@mail.test").count() == 0


def test_insert_and_update_by_upsert(spark, users):
    changes = spark.createDataFrame(
        [(1, "cleo@mail.test", "mid", "mid"), (2, "cleo@mail.test", "birch-2", "cleo two"), (3, "eli@mail.test", "p", "u")],
        CHANGES,
    )
    got = {r.email: (r.password, r.username) for r in K.upsert(users, changes, "email", "seq").collect()}
    assert got["cleo@mail.test"] == ("birch-2", "cleo two") and got["eli@mail.test"] == ("p", "u")
    assert got["ada@mail.test"] == ("violet-9", "ada") and len(got) == 5


def test_delete(spark, users):
    gone = spark.createDataFrame([(1, "dina@mail.test", "", ""), (2, "nobody@mail.test", "", "")], CHANGES)
    left = K.delete(users, gone, "email")
    assert K.get_by_key(left, "email", "dina@mail.test").count() == 0 and left.count() == 3
    assert statuses(K.delete_status(gone, users)) == {
        "dina@mail.test": "deleted", "nobody@mail.test": "not_found"
    }


def test_login(spark, users):
    tries = spark.createDataFrame(
        [(1, "ada@mail.test", "violet-9", ""), (2, "nobody@mail.test", "x", ""), (3, "ben@mail.test", "maple-5", "")],
        CHANGES,
    )
    assert statuses(K.login_status(tries, users)) == {
        "ada@mail.test": "ok", "nobody@mail.test": "not_found", "ben@mail.test": "invalid"
    }


def test_register(spark, users):
    new = spark.createDataFrame([(1, "ada@mail.test", "other", "other"), (2, "fay@mail.test", "p", "u")], CHANGES)
    assert statuses(K.register_status(new, users)) == {"ada@mail.test": "exists", "fay@mail.test": "created"}
    after = {r.email: r.password for r in K.register(users, new).collect()}
    assert after["ada@mail.test"] == "violet-9" and after["fay@mail.test"] == "p"


def test_update_password(spark, users):
    asks = spark.createDataFrame([(1, "cleo@mail.test", "birch-2", ""), (2, "nobody@mail.test", "x", "")], CHANGES)
    assert statuses(K.update_status(asks, users)) == {
        "cleo@mail.test": "updated", "nobody@mail.test": "not_found"
    }
    after = {r.email: (r.password, r.username) for r in K.update_password(users, asks).collect()}
    assert after["cleo@mail.test"] == ("birch-2", "cleo") and len(after) == 4
