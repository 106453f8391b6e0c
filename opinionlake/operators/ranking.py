"""Keep-first, caps and top-n that stay parallel when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row per key in a total order.

    Spark limits every map task to one row per key before the shuffle, so a
    key holding a third of the table reaches its reducer as one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def head_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str = "position"
) -> DataFrame:
    """First ``n`` rows per key in ascending total order, with their rank.

    Two rounds, for any ``n``: rows are dealt into as many slices as the
    session has shuffle partitions, so that a key that holds everything is
    ranked by all of them, and each slice keeps ``n`` rows per key; then these
    at most ``n`` * slices rows are ranked. The outcome does not depend on how
    rows are dealt.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = Window.partitionBy(*keys, "_slice").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(parts)))
        .withColumn(rank, F.row_number().over(slices))
        .where(F.col(rank) <= n)
        .drop("_slice")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= n)
    )


def fill_from(
    first: DataFrame, second: DataFrame, key: Column, order: str, cap: int
) -> DataFrame:
    """Rows of ``first``, filled from ``second`` up to ``cap``, one per key."""
    both = first.withColumn("priority", F.lit(0)).unionByName(
        second.withColumn("priority", F.lit(1))
    )
    ranked = [F.col("priority"), F.col(order)]
    return first_by(both.withColumn("_key", key), ["_key"], ranked).drop("_key").orderBy(*ranked).limit(cap)
