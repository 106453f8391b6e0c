"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations and joins; no component is ever in one task. The
links of every round are written to the shared folder, so a lost executor costs
one round at most. Hot nodes are partly aggregated before a shuffle, and their
joins can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionlake.session import remove_dir, run_dir


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where(F.col("a") != F.col("b")).distinct()
    # All links now point to a smaller node.
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    linked = large.join(down, "a")
    small = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(down.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node but the smallest of its component, and that smallest node."""
    spark = links.sparkSession
    folder = run_dir(spark, "links")
    schema = links.select("a", "b").schema
    marks = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    before, step = None, 0
    links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(f"{folder}/0")
    while True:
        now = spark.read.schema(schema).parquet(f"{folder}/{step}")
        mark = now.agg(*marks).first()
        if mark == before or not mark["n"]:
            return now
        before, step = mark, step + 1
        _stars(now).write.parquet(f"{folder}/{step}")
        remove_dir(spark, f"{folder}/{step - 1}")
