"""Keyed tables: content keys, insert-only merge, user maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.functions.values import content_key, na_to_null, rating_text
from opinionlake.operators.ranking import first_by


def with_raw_id(df: DataFrame) -> DataFrame:
    """Raw rows as text with their content key ``raw_id``."""
    plain = df.withColumns({c: na_to_null(c) for c in ("rating", "date", "content")})
    key = content_key(F.col("site"), F.col("date"), rating_text(F.col("rating")), F.col("content"))
    return plain.withColumn("raw_id", key)


def with_processed_id(df: DataFrame, text: str = "content_clean") -> DataFrame:
    """Cleaned rows with the key of what cleaning made of them."""
    date = F.date_format("date", "yyyy-MM-dd")
    key = content_key(F.col("site"), date, F.col("rating").cast("string"), F.col(text))
    return df.withColumn("processed_id", key)


def new_only(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``; repeated keys there do no harm."""
    return rows.join(done.select(key), key, "left_anti")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def to_insert(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """First copy of each batch key that the target does not hold."""
    return new_only(first_by(batch, [key], [F.col(order)]), target, key)


def insert_only_merge(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The target as it is, plus the batch's new keys."""
    return target.unionByName(to_insert(target, batch, key, order), allowMissingColumns=True)


def merge_stats(target: DataFrame, batch: DataFrame, key: str, by: Sequence[str] = ("site",)) -> DataFrame:
    """Per group: batch rows, inserted keys, rows matching an existing key.

    Rows are counted per key before the join, so a hot key is one row in it.
    A copy of a key inserted by the same batch counts as matched.
    """
    keys = batch.groupBy(*by, key).agg(F.count("*").alias("n"))
    flagged = keys.join(distinct_keys(target, key).withColumn("known", F.lit(True)), key, "left")
    inserted = F.count_if(F.col("known").isNull())
    return flagged.groupBy(*by).agg(
        F.sum("n").alias("batch_rows"),
        inserted.alias("inserted"),
        (F.sum("n") - inserted).alias("matched"),
    )


def append_new(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    key: str,
    order: str,
    run: str,
    partition: str | None = "site",
    values: Sequence | None = None,
) -> None:
    """Append a batch's new keys to the Parquet table at ``path``.

    One writer per table. Rows land in the ``run`` partition; a rerun after
    a crash finds what was written before and adds only the rest. ``values``
    are the values of ``partition`` the batch holds, where they are known (a
    key belongs to one of them): only these partitions are read.
    """
    known = read_table(spark, path)
    if known is not None and partition and values is not None:
        given = F.col(partition).isin(*[v for v in values if v is not None])
        known = known.where(given | F.col(partition).isNull() if None in values else given)
    fresh = to_insert(known, batch, key, order) if known is not None else first_by(batch, [key], [F.col(order)])
    folders = [partition, "run"] if partition else ["run"]
    fresh.withColumn("run", F.lit(run)).write.mode("append").partitionBy(*folders).parquet(path)


def insert_only(
    spark: SparkSession, path: str, batch: DataFrame, key: str, order: str, run: str, partition: str = "site"
) -> dict[str, int]:
    """``append_new`` with its counts. They come from the written files, not
    from task-side counters, which retries would inflate."""
    append_new(spark, path, batch, key, order, run, partition=partition)
    inserted = spark.read.parquet(path).where(F.col("run") == run).count()
    total = batch.count()
    return {"total": total, "inserted": inserted, "matched": total - inserted}


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table, or None when nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def unique_names(keys: Column, safe: Column) -> Column:
    """Names for a list of keys: the safe form, with ``_2``, ``_3``, ... where
    an earlier key of the list took it. ``keys`` and ``safe`` run parallel.

    Meant for the fields of one record, at most ``max_features`` of them.
    """
    def add(names: Column, name: Column) -> Column:
        taken = F.size(F.filter(names, lambda n: n.startswith(F.concat(name, F.lit("_")))))
        tries = F.transform(F.sequence(F.lit(2), taken + 2), lambda i: F.concat(name, F.lit("_"), i.cast("string")))
        free = F.filter(tries, lambda t: ~F.array_contains(names, t))
        chosen = F.when(F.array_contains(names, name), free[0]).otherwise(name)
        return F.concat(names, F.array(chosen))

    named = F.aggregate(safe, F.array().cast("array<string>"), add)
    return F.zip_with(keys, named, lambda k, n: F.struct(k.alias("key"), n.alias("name")))


# --- user table ---------------------------------------------------------------
# Statuses are judged against the snapshot; of several changes to one key the
# one with the highest sequence number wins.


def get_by_key(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == value)


def get_by_keys(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Batch lookup: one row per distinct wanted key with ``found``."""
    return distinct_keys(wanted, key).join(table.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Table with the latest change per key applied, new keys added."""
    columns = table.columns
    stamped = table.withColumn("_seq", F.lit(None).cast("long")).unionByName(
        changes.select(*columns, F.col(order).cast("long").alias("_seq"))
    )
    return first_by(stamped, [key], [F.col("_seq").desc_nulls_last()]).drop("_seq")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def _against(changes: DataFrame, table: DataFrame, key: str, *fields: str) -> DataFrame:
    known = table.select(key, *[F.col(f).alias(f"known_{f}") for f in fields], F.lit(True).alias("known"))
    return changes.join(known, key, "left")


def login_status(attempts: DataFrame, table: DataFrame) -> DataFrame:
    joined = _against(attempts, table, "email", "password")
    status = (
        F.when(F.col("known").isNull(), "not_found")
        .when(F.col("known_password") == F.col("password"), "ok")
        .otherwise("invalid")
    )
    return joined.withColumn("status", status).select(*attempts.columns, "status")


def presence_status(changes: DataFrame, table: DataFrame, present: str, absent: str) -> DataFrame:
    """Status per change by whether its key is in the snapshot."""
    joined = _against(changes, table, "email")
    status = F.when(F.col("known"), present).otherwise(absent)
    return joined.withColumn("status", status).select(*changes.columns, "status")


def register_status(changes: DataFrame, table: DataFrame) -> DataFrame:
    return presence_status(changes, table, "exists", "created")


def update_status(changes: DataFrame, table: DataFrame) -> DataFrame:
    return presence_status(changes, table, "updated", "not_found")


def delete_status(changes: DataFrame, table: DataFrame) -> DataFrame:
    return presence_status(changes, table, "deleted", "not_found")


def register(table: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Adds unknown keys only; an existing user is left untouched."""
    return table.unionByName(
        new_only(first_by(changes, ["email"], [F.col(order).desc()]), table, "email").select(*table.columns)
    )


def update_password(table: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Latest password change per known user; unknown keys change nothing."""
    latest = first_by(changes, ["email"], [F.col(order).desc()]).select("email", F.col("password").alias("_new"))
    return table.join(latest, "email", "left").withColumn("password", F.coalesce("_new", "password")).select(
        *table.columns
    )
