"""Review files in, processed tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.operators.cleaning import null_tokens, require_columns
from opinionlake.profiles import SITES

SUBJECT = "map<string, struct<title string, author string, summary string, keywords array<string>>>"


def _csv(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8", inferSchema=False)
    return (reader.option("pathGlobFilter", name) if name else reader).csv(path)


def read_reviews(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Review CSV as text columns in any order; missing tokens become NULL.
    ``name`` picks files of a folder by pattern.

    A quoted text may span lines, which keeps a file in one task: hand over
    many files, not one large one.
    """
    df = require_columns(_csv(spark, path, name))
    return null_tokens(df.select("rating", "date", "content"))


def read_all(spark: SparkSession, folder: str, sites: tuple[str, ...] = SITES) -> DataFrame:
    """All ``reviews_<site>.csv`` of a folder with their site; files of
    unknown sites are skipped. Column order may differ between sites."""
    out: DataFrame | None = None
    for site in sites:
        try:
            part = read_reviews(spark, folder, f"reviews_{site}.csv").withColumn("site", F.lit(site))
        except AnalysisException as missing:
            if missing.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no review files in {folder}")
    return out


def load_raw(spark: SparkSession, path: str, sites: str | Sequence[str]) -> DataFrame:
    """Sites of the keyed raw store: their partitions, needed columns only."""
    sites = (sites,) if isinstance(sites, str) else tuple(sites)
    return spark.read.parquet(path).where(F.col("site").isin(*sites)).select(
        "raw_id", "review_seq", "site", "rating", "date", "content"
    )


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet by site, or CSV with a header for flat tables. An empty result
    keeps its schema as Parquet."""
    if fmt == "csv":
        df.write.mode(mode).options(header=True, escape='"').csv(path)
    elif "site" in df.columns:
        df.write.mode(mode).partitionBy("site").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """Subject table from one JSON object of objects."""
    text = spark.read.text(path, wholetext=True)
    return (
        text.select(F.explode(F.from_json("value", SUBJECT)).alias("key", "s"))
        .select("key", "s.title", "s.author", "s.summary", "s.keywords")
    )

