"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load() -> tuple[dict, dict]:
    """All queries and their SQL; imports every operator module."""
    from opinionlake.llm import (  # noqa: F401
        ann,
        chat_format,
        decontaminate,
        exact_topk,
        jaccard_join,
        langid,
        lexical,
        licenses,
        packing,
        quality,
        substring_dedup,
        token_output,
        whitening,
    )

    return QUERIES, ORACLES
