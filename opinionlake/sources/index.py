"""Retrieval corpus and its persisted vector table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.functions.text import first_text
from opinionlake.functions.values import strip
from opinionlake.operators.keyed import read_table
from opinionlake.operators.ranking import head_per


def load_corpus(df: DataFrame, cap: int | None = None, order: str = "review_seq") -> DataFrame:
    """Documents for retrieval: cleaned or else raw text; with ``cap`` the
    first so many rows with text per site. Blank ones are dropped last."""
    docs = df.withColumn("page_content", first_text(F.col("content_clean"), F.col("content"))).where(
        F.col("page_content").isNotNull()
    )
    if cap is not None:
        docs = head_per(docs, ["site"], [order], cap).drop("position")
    return docs.withColumn("page_content", strip(F.col("page_content"))).where(F.col("page_content") != "").select(
        F.col(order).alias("doc_id"),
        "page_content",
        F.concat(F.lit("preprocessed_reviews_"), F.col("site"), F.lit(".csv")).alias("source_file"),
        "rating",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
    )


def index_meta(df: DataFrame, built_from: str) -> DataFrame:
    return df.agg(F.count("*").alias("doc_count")).withColumn("built_from", F.lit(built_from))


def build_or_load_index(
    spark: SparkSession, path: str, corpus: Callable[[], DataFrame], built_from: str
) -> tuple[DataFrame, DataFrame]:
    """(vectors, meta), reused when both tables hold rows, else written."""
    vectors, meta = read_table(spark, f"{path}/vectors"), read_table(spark, f"{path}/meta")
    if vectors is None or meta is None or vectors.isEmpty() or meta.isEmpty():
        corpus().write.mode("overwrite").parquet(f"{path}/vectors")
        vectors = spark.read.parquet(f"{path}/vectors")
        index_meta(vectors, built_from).write.mode("overwrite").parquet(f"{path}/meta")
        meta = spark.read.parquet(f"{path}/meta")
    return vectors, meta
