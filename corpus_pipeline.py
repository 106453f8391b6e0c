"""From raw documents to packed training sequences.

Five stages, each over all that its predecessor kept: quality classifier (what
it rejects goes), n-gram Jaccard join (one document of each group stays),
substring dedup (repeated passages are cut out of the texts), benchmark
decontamination (documents with a benchmark item go), packing. All but the last
return the columns of the documents they were given. Each result is written as
Parquet to the shared folder and read again, so a lost executor costs one stage
at most.

No SQL: a fitted classifier and the packing of token ids can't be written in
it. The tests check columns and kept ids of each stage; the operators behind
them have tests against plain versions of their own.

Cases: null and empty texts pass the stages as the operators define them (they
are scored, link with nothing, and pack as the end id alone); rows that share
an id, or are equal, are documents of their own until the Jaccard join keeps one
of those with the same words; ties go to the smaller id; a null id comes first;
extra columns are carried to the last stage, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from opinionlake.llm.registry import table
from opinionlake.session import remove_dir, run_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; ``n_chars``, where given, follows the text."""
    cut = substring_dedup.dedupe(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return cut
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.length("text").cast(kind))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, forget=True).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = run_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove_dir(spark, f"{folder}/{i - 1}")
    return docs
