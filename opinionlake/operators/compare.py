"""Numbers that compare the sites: months, histograms, tokens, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.functions.values import month_of, to_five
from opinionlake.operators.cleaning import per_site
from opinionlake.profiles import PROFILES


def site_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("site").agg(
        F.count("*").alias("n_rows"),
        F.min("date").cast("date").alias("first_date"),
        F.max("date").cast("date").alias("last_date"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
    )


def rescale(df: DataFrame) -> DataFrame:
    """Adds ``rating_5``: every site's rating on the 5-point scale."""
    scale = per_site({s: F.lit(p.rating_scale) for s, p in PROFILES.items()})
    return df.withColumn("rating_5", to_five(F.col("rating"), scale))


def _fill_months(months: DataFrame, value: str, empty: Column) -> DataFrame:
    """Insert the missing months between a site's first and last one.

    Works on the aggregated table (one row per site and month): each row
    opens the months up to the next one, so the data is read once.
    """
    ahead = F.lead("month").over(Window.partitionBy("site").orderBy("month"))
    last = F.coalesce(F.add_months("_next", -1), F.col("month"))
    run = F.sequence(F.col("month"), last, F.expr("interval 1 month"))
    return (
        months.withColumn("_next", ahead)
        .withColumn("_first", F.col("month"))
        .withColumn("month", F.explode(run))
        .withColumn(value, F.when(F.col("month") == F.col("_first"), F.col(value)).otherwise(empty))
        .drop("_next", "_first")
    )


def _months(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy("site", month_of(F.col("date")).alias("month")).agg(value.alias(name))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.last_day("month"))


def monthly_count(df: DataFrame) -> DataFrame:
    """Rows per site and month, labelled by month end; empty months are 0."""
    return _labelled(_fill_months(_months(df, F.count("*"), "n_reviews"), "n_reviews", F.lit(0)))


def monthly_mean(df: DataFrame, column: str = "rating") -> DataFrame:
    """Mean rating per site and month; empty months are NULL."""
    return _labelled(_fill_months(_months(df, F.avg(column), "mean_rating"), "mean_rating", F.lit(None)))


def rolling(monthly: DataFrame, value: str, n: int = 3) -> DataFrame:
    """Mean over the last ``n`` months of a filled monthly table."""
    w = Window.partitionBy("site").orderBy("month").rowsBetween(-(n - 1), 0)
    return monthly.withColumn("rolling_mean", F.avg(value).over(w))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over each site's range, the last one closed.

    Equal values are counted before anything is shuffled, so ranges and bins
    come from one row per distinct value and the data is read once. A site
    with a single value has bins of one unit's total width around it.
    """
    site = Window.partitionBy("site")
    low, high = F.min("v").over(site), F.max("v").over(site)
    counted = df.groupBy("site", F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = counted.select(
        "site", "v", "n",
        F.when(low == high, low - 0.5).otherwise(low).alias("lo"),
        F.when(low == high, high + 0.5).otherwise(high).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    filled = ranged.groupBy("site", "lo", "hi").agg(
        *[F.sum(F.when(at == b, F.col("n")).otherwise(0)).alias(f"b{b}") for b in range(bins)]
    )
    pairs = F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"b{b}").alias("n")) for b in range(bins)])
    out = filled.select("site", width.alias("w"), "lo", F.inline(pairs))
    return out.select(
        "site", "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_high"),
        F.col("n"),
    )


def token_freq(df: DataFrame, group: str, text: str, pattern: str = "[가-힣]{2,}", per: int = 10000) -> DataFrame:
    """Token counts per group and their rate per ``per`` tokens.

    Counts are combined before the shuffle on (group, token), and the totals
    read the same exchange. They join back without a hint: Spark broadcasts
    them only if they turn out small and otherwise splits skewed groups.
    """
    listed = df.select(group, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("_t"))
    tokens = listed.select(group, F.explode_outer("_t").alias("token")).where(F.col("token").isNotNull())
    counts = tokens.groupBy(group, "token").agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    return counts.join(totals, group).select(
        group, "token", "n", (F.col("n") * F.lit(float(per)) / F.col("total")).alias("rate")
    )


def length_density(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density of a length over an even grid per site.

    Bandwidth is the usual n^(-1/5) times the sample deviation. Equal lengths
    are counted first; each distinct length then spreads over the fixed grid.
    """
    site = Window.partitionBy("site")
    counted = df.groupBy("site", F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(site)
    mean = F.sum(F.col("n") * F.col("v")).over(site) / total
    shaped = (
        counted.withColumn("total", total)
        .withColumn("_d", F.col("v") - mean)
        .withColumn("lo", F.min("v").over(site))
        .withColumn("hi", F.max("v").over(site))
        .withColumn("sd", F.sqrt(F.sum(F.col("n") * F.col("_d") * F.col("_d")).over(site) / (F.col("total") - 1)))
        .withColumn("h", F.col("sd") * F.pow("total", F.lit(-0.2)))
        .where(F.col("h") > 0)
    )
    grid = shaped.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    )
    z = (F.col("x") - F.col("v")) / F.col("h")
    bump = F.col("n") * F.exp(-z * z / 2) / (F.col("total") * F.col("h") * F.sqrt(2 * F.pi()))
    return grid.groupBy("site", "point").agg(F.first("x").alias("x"), F.sum(bump).alias("density"))
