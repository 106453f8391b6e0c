"""Exact quantiles of columns with any number of distinct values.

``percentile`` keeps a count per distinct value in its buffer, which is fine for
lengths and fails for prices or scores. Here a rank is found in rounds. A
mergeable sketch of fixed size cuts the values still in question into cells,
whose borders around the wanted rank are then counted exactly; a round leaves
some 4 of 1,000 cells. The counts decide where to go on, so a wrong sketch costs
a round and never the result. A border is excluded from what is left, so values
that a third of all rows share can't hold a round up. Only ranks with at most
``limit`` values left are sorted. Every round reads one column and the groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.session import run_dir

CELLS = 1000
STATE = ["_k", "_lo", "_hi", "_skip", "_left"]


def _same(left: str, right: str, by: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in by])


def _inner(rows: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values strictly inside the open interval of each rank (two at most per group)."""
    a, b = rows.alias("a"), ranks.alias("b")
    inside = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    more = [F.col(f"b.{c}") for c in ranks.columns if c not in by]
    return a.join(b, _same("a", "b", by)).where(inside).select(*[F.col(f"b.`{k}`") for k in by], "a._v", *more)


def _narrow(rows: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """One round: ranks with a smaller interval, or with their value ``_found``."""
    keys = [*by, *STATE]
    steps = [i / CELLS for i in range(CELLS + 1)]
    at = (F.col("_k") - F.col("_skip")) / F.col("_left") * CELLS
    low = F.greatest(F.floor(at) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil(at) + 1, F.lit(CELLS)).cast("int")
    cells = _inner(rows, ranks, by).groupBy(*keys).agg(F.percentile_approx("_v", steps, 10 * CELLS).alias("_g"))
    marks = cells.select(*keys, F.get("_g", low).alias("_l"), F.get("_g", high).alias("_h"))

    v, lo, hi = F.col("_v"), F.col("_l"), F.col("_h")
    counted = _inner(rows, marks, by).groupBy(*keys, "_l", "_h").agg(
        F.count_if(v < lo).alias("_below"),
        F.count_if(v == lo).alias("_at_l"),
        F.count_if((v > lo) & (v < hi)).alias("_between"),
        F.count_if((v == hi) & (hi > lo)).alias("_at_h"),
    )
    r = F.col("_k") - F.col("_skip")
    to_l, to_b = F.col("_below") + F.col("_at_l"), F.col("_below") + F.col("_at_l") + F.col("_between")
    to_h = to_b + F.col("_at_h")

    def pick(under: Column, at_l: Column, between: Column, at_h: Column, over: Column) -> Column:
        return F.when(r < F.col("_below"), under).when(r < to_l, at_l).when(r < to_b, between).when(r < to_h, at_h).otherwise(over)

    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    skip = F.col("_skip")
    return counted.select(
        *by,
        "_k",
        pick(F.col("_lo"), none, lo, none, hi).alias("_lo"),
        pick(lo, none, hi, none, F.col("_hi")).alias("_hi"),
        pick(skip, zero, skip + to_l, zero, skip + to_h).alias("_skip"),
        pick(F.col("_below"), zero, F.col("_between"), zero, F.col("_left") - to_h).alias("_left"),
        pick(none, lo, none, hi, none).alias("_found"),
    )


def exact_quantile(df: DataFrame, column: str, p: float, by: Sequence[str], limit: int = 10_000) -> DataFrame:
    """(by..., bound): the linearly interpolated quantile of each group.

    Nulls don't count; a group without values has no row, an empty table gives
    none. A null group is a group. NaN is above all numbers, as everywhere in
    Spark. Group names must not start with an underscore.
    """
    spark = df.sparkSession
    folder = run_dir(spark, "quantile")
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    place = F.lit(float(p)) * (F.col("_n") - 1)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_at", place)
    sizes.write.parquet(f"{folder}/sizes")
    sizes = spark.read.schema(sizes.schema).parquet(f"{folder}/sizes")
    none = F.lit(None).cast("double")
    both = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    state = sizes.select(
        *by, F.explode(both).alias("_k"), none.alias("_lo"), none.alias("_hi"),
        F.lit(0).cast("long").alias("_skip"), F.col("_n").alias("_left"), none.alias("_found"),
    )
    parts, turn = [], 0
    wide = F.col("_found").isNull() & (F.col("_left") > limit)
    while True:
        parts.append(state.where(~wide))
        state = state.where(wide)
        if state.isEmpty():
            break
        state = _narrow(rows, state.drop("_found"), by)
        state.write.parquet(f"{folder}/{turn}")
        state = spark.read.schema(state.schema).parquet(f"{folder}/{turn}")
        turn += 1
    settled = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy(*by, "_k").orderBy("_v")
    few = _inner(rows, settled.where("_found IS NULL").drop("_found"), by).withColumn("_i", F.row_number().over(order) - 1)
    values = settled.where("_found IS NOT NULL").select(*by, "_k", "_found").unionByName(
        few.where(F.col("_i") == F.col("_k") - F.col("_skip")).select(*by, "_k", F.col("_v").alias("_found"))
    )
    s, v = sizes.alias("s"), values.alias("v")
    ends = s.join(v, _same("s", "v", by)).groupBy(*[F.col(f"s.`{k}`") for k in by], "s._at").agg(
        F.min("_found").alias("_a"), F.max("_found").alias("_b")
    )
    share = F.col("_at") - F.floor("_at")
    return ends.select(*by, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("bound"))
