"""Jobs: features for cleaned reviews, the incremental run, the full batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.functions.values import date_parts, safe_key
from opinionlake.operators import tfidf as T
from opinionlake.operators.cleaning import ALL, preprocess
from opinionlake.operators.keyed import (
    append_new,
    distinct_keys,
    new_only,
    read_table,
    unique_names,
    with_processed_id,
    with_raw_id,
)
from opinionlake.operators.ranking import first_by
from opinionlake.profiles import PROFILES
from opinionlake.session import remove_dir, run_dir
from opinionlake.sources.files import load_raw, save


def with_dates(df: DataFrame) -> DataFrame:
    return df.withColumns(date_parts(F.col("date")))


def attach(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Features onto rows; a row without features keeps NULLs."""
    return df.join(features, key, "left")


def featurize(df: DataFrame, profiles: T.Profiles, id_col: str = "review_seq") -> DataFrame:
    """Cleaned rows with date parts, TF-IDF terms and their sums. Rows
    without a kept term, and an empty vocabulary, give zeros."""
    weights = T.tfidf_rows(df, profiles, id_col).drop("site").withColumns(T.row_sums())
    return attach(with_dates(df), weights, id_col)


def fitted_features(df: DataFrame, profiles: T.Profiles, work: str, id_col: str = "review_seq") -> DataFrame:
    """``featurize`` plus the map of field-safe names, from one fit: the kept
    vocabulary (at most ``max_features`` rows per profile) is written to
    ``work``, and weights and names both read it."""
    rows = T.partition_rows(T.sited(df, profiles).select(id_col, "site", "content_clean"), id_col)
    fitted = T.fit(rows, profiles)
    fitted.write.parquet(f"{work}/vocabulary")
    vocab = df.sparkSession.read.schema(fitted.schema).parquet(f"{work}/vocabulary")
    weights = T.weigh(rows, named(vocab), profiles, id_col).withColumns({**T.row_sums(), "tfidf": name_map()})
    return attach(with_dates(df), weights.drop("site", "terms"), id_col)


def term_names(vocab: DataFrame) -> DataFrame:
    """(site, term, name): field-safe unique names of each site's vocabulary,
    taken in term order. A list holds at most ``max_features`` terms."""
    listed = T.real_terms(vocab).groupBy("site").agg(F.array_sort(F.collect_list("term")).alias("_k"))
    named = unique_names(F.col("_k"), F.transform("_k", safe_key))
    return listed.select("site", F.explode(named).alias("_n")).select("site", F.col("_n.key").alias("term"), "_n.name")


def named(vocab: DataFrame) -> DataFrame:
    """The vocabulary's terms with their names; at most ``max_features`` rows per profile."""
    return T.real_terms(vocab).join(term_names(vocab), ["site", "term"])


def name_map() -> Column:
    """Map<name, weight> of a row's named terms; NULL without any."""
    pairs = F.transform("terms", lambda t: F.struct(t["name"].alias("name"), t["tfidf"].alias("tfidf")))
    return F.when(F.size("terms") > 0, F.map_from_entries(pairs))


def tfidf_maps(df: DataFrame, profiles: T.Profiles, id_col: str = "review_seq") -> DataFrame:
    """(id, tfidf map<name, weight>) for every row with a kept term."""
    rows = T.partition_rows(T.sited(df, profiles).select(id_col, "site", "content_clean"), id_col)
    weights = T.weigh(rows, named(T.fit(rows, profiles)), profiles, id_col)
    return weights.where(F.size("terms") > 0).select(id_col, name_map().alias("tfidf"))


def seed(df: DataFrame) -> DataFrame:
    """Raw store rows: text columns, content key, first copy per key."""
    return first_by(with_raw_id(df), ["raw_id"], [F.col("review_seq")])


def run_stats(raw: DataFrame, todo: DataFrame, processed: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of an incremental run, one row per site of ``raw``: ``todo`` has
    the rows no earlier run has seen, ``processed`` the ids of written documents."""
    taken = todo.groupBy("site").agg(F.count("*").alias("to_process_count"))
    todo = raw.groupBy("site").agg(F.count("*").alias("raw_count")).join(taken, "site", "left")
    written = distinct_keys(processed, "processed_id").withColumn("known", F.lit(True))
    keys = rows.groupBy("site", "processed_id").agg(F.count("*").alias("n"))
    made = keys.join(written, "processed_id", "left").groupBy("site").agg(
        F.sum("n").alias("processed_rows"), F.count_if(F.col("known").isNull()).alias("inserted_new")
    )
    counts = todo.join(made, "site", "left").fillna(0)
    return counts.withColumn("matched_existing", F.col("processed_rows") - F.col("inserted_new"))


def _known(spark: SparkSession, path: str, key: str, sites: Sequence[str]) -> DataFrame:
    """Keys of a table partitioned by site, read from the given sites only."""
    table = read_table(spark, path)
    if table is None:
        return spark.createDataFrame([], f"{key} string")
    return table.where(F.col("site").isin(*sites)).select(key)


def run_incremental(
    spark: SparkSession, raw_path: str, out_path: str, sites: str | Sequence[str], as_of: dt.datetime, run: str
) -> DataFrame:
    """Process the sites' raw rows that no earlier run has seen, and append
    their documents.

    Two tables below ``out_path``, by site and run: ``documents``, and
    ``ledger`` with every raw id a run has seen and whether cleaning kept it.
    Rejected rows are so never taken up again. The ledger is written last: a
    run that broke off is done again as a whole, and inserts only what it had
    not written. Cleaned rows and the vocabulary are written to the shared
    folder first and removed at the end.
    """
    sites = (sites,) if isinstance(sites, str) else tuple(sites)
    profiles = [PROFILES[s] for s in sites]
    raw = load_raw(spark, raw_path, sites)
    seen = _known(spark, f"{out_path}/ledger", "raw_id", sites)
    processed = _known(spark, f"{out_path}/documents", "processed_id", sites)
    work = run_dir(spark, "incremental")
    unseen = new_only(raw, seen, "raw_id")
    save(unseen, f"{work}/todo")
    todo = spark.read.schema(unseen.schema).parquet(f"{work}/todo")
    clean = with_processed_id(preprocess(todo, profiles, as_of, work=work))
    save(clean, f"{work}/clean")
    rows = spark.read.schema(clean.schema).parquet(f"{work}/clean")
    stats = run_stats(raw, todo, processed, rows)
    counts = spark.createDataFrame(stats.collect(), stats.schema)  # one row per site
    documents = fitted_features(rows, profiles, work)
    append_new(spark, f"{out_path}/documents", documents, "processed_id", "review_seq", run, values=sites)
    kept = rows.select("raw_id", F.lit("kept").alias("outcome"))
    todo.select("site", "raw_id").join(kept, "raw_id", "left").select(
        "site", F.lit(run).alias("run"), "raw_id", F.coalesce("outcome", F.lit("rejected")).alias("outcome")
    ).write.mode("append").partitionBy("site", "run").parquet(f"{out_path}/ledger")
    remove_dir(spark, work)
    return counts


def run_all(reviews: DataFrame, out_path: str, as_of: dt.datetime) -> DataFrame:
    """Clean and featurise all sites in one job, one table by site."""
    spark = reviews.sparkSession
    work = run_dir(spark, "all-sites")
    clean = preprocess(reviews, ALL, as_of, work=work)
    save(clean, f"{work}/clean")
    rows = spark.read.schema(clean.schema).parquet(f"{work}/clean")
    save(featurize(rows, ALL), out_path)
    remove_dir(spark, work)
    return spark.read.parquet(out_path)
