"""Streams: idempotent ingest and daily counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.operators.keyed import append_new, read_table
from opinionlake.session import remove_dir, run_dir
from opinionlake.sources.samples import SCHEMAS


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """Stream over one table of a folder, event time as TIMESTAMP."""
    stream = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_ingest(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: list[str],
    event_time: str = "ts",
    partition: str | None = None,
) -> None:
    """Append each new key once to the table at ``target``; runs until the
    available input is read.

    The table itself knows which keys came before, however late a new one is,
    so no state is kept and no row is dropped. Copies, and batches replayed
    after a failure, are caught by the anti-join with the table. With
    ``partition`` (one of the keys, such as the day) a batch reads only those
    of its partitions that the batch's own rows belong to.
    """
    if partition is not None and partition not in keys:
        raise ValueError("the partition must be one of the keys")
    spark = stream.sparkSession
    key = F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in keys]), 256)

    def write(batch: DataFrame, epoch: int) -> None:
        # As many values as a batch has days.
        values = [r[0] for r in batch.select(partition).distinct().collect()] if partition else None
        append_new(spark, target, batch, "key", event_time, f"batch-{epoch}", partition, values)

    query = (
        stream.withColumn("key", key)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_counts(stream: DataFrame, value: Column, width: str = "1 day", delay: str = "1 day", event_time: str = "ts") -> DataFrame:
    """Tumbling count and sum over event time. Months are no window length:
    stream days and add them up."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")
    )


def run_counts(counts: DataFrame, target: str, checkpoint: str) -> None:
    """Keep the table at ``target`` equal to the whole aggregate: each batch
    writes a version of its own, so readers never see half of one. The version
    before stays for readers that have begun; older ones are removed."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={epoch}")
        if epoch >= 2:
            remove_dir(batch.sparkSession, f"{target}/version={epoch - 2}")

    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    table = read_table(spark, target)
    newest = table.agg(F.max("version").alias("v"))
    return table.where(F.col("version") == newest.scalar()).drop("version")


def run_day_counts(stream: DataFrame, value: Column, target: str, checkpoint: str, event_time: str = "ts", open_batches: int = 16) -> None:
    """Add the available input to the day counts at ``target``, without state.

    A batch writes the counts of its own rows by day, under its number, so a
    replay overwrites itself, and a row that comes late, however late, corrects
    its day. With more than ``open_batches`` of them they are folded, so what a
    reader adds up stays small. A stream keeps nothing between batches.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        days = batch.groupBy(F.to_date(event_time).alias("day")).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("total"))
        days.write.mode("overwrite").parquet(f"{target}/batches/batch={epoch}")
        if len(_open_counts(batch.sparkSession, target)[1]) > open_batches:
            fold_day_counts(batch.sparkSession, target)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the completely written folders ``name=number`` below ``folder``, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return []
    found = [s.getPath() for s in fs.listStatus(path(folder))]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(path(p, "_SUCCESS")))


def _open_counts(spark: SparkSession, target: str) -> tuple[list[int], list[int]]:
    """(folds, batches after the newest fold)."""
    folds = _finished(spark, f"{target}/folds")
    newest = folds[-1] if folds else -1
    return folds, [b for b in _finished(spark, f"{target}/batches") if b > newest]


COUNTS = "day date, n long, total double"


def _added(spark: SparkSession, target: str, folds: list[int], batches: list[int]) -> DataFrame:
    paths = [f"{target}/folds/fold={f}" for f in folds[-1:]] + [f"{target}/batches/batch={b}" for b in batches]
    rows = spark.read.schema(COUNTS).parquet(*paths) if paths else spark.createDataFrame([], COUNTS)
    return rows.groupBy("day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fold_day_counts(spark: SparkSession, target: str) -> None:
    """Fold all batches but the newest, which may be replayed, into one table
    named by the last of them. What the fold before has replaced is removed;
    what this one replaces stays for readers that have begun."""
    folds, batches = _open_counts(spark, target)
    if len(batches) < 2:
        return
    _added(spark, target, folds, batches[:-1]).write.mode("overwrite").parquet(f"{target}/folds/fold={batches[-2]}")
    if folds:
        for b in [b for b in _finished(spark, f"{target}/batches") if b <= folds[-1]]:
            remove_dir(spark, f"{target}/batches/batch={b}")
        for f in folds[:-1]:
            remove_dir(spark, f"{target}/folds/fold={f}")


def day_counts(spark: SparkSession, target: str) -> DataFrame:
    """(day, n, total) over all that has arrived."""
    return _added(spark, target, *_open_counts(spark, target))


def late_days(spark: SparkSession, folder: str) -> DataFrame:
    """Day counts of events that arrive in four deliveries, the last days
    first, and every day's rows spread over several of them."""
    base = run_dir(spark, "late-days")
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{folder}/events.parquet")
    turn = F.pmod(F.dayofmonth("ts") + F.col("event_id") % 11, F.lit(32))
    for low, high in ((24, 31), (16, 23), (8, 15), (0, 7)):
        events.where(turn.between(low, high)).write.mode("append").parquet(f"{base}/arrived")
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{base}/arrived")
        run_day_counts(stream, F.col("value"), f"{base}/table", f"{base}/checkpoint", open_batches=1)
    return day_counts(spark, f"{base}/table")


def roll_up_months(daily: DataFrame) -> DataFrame:
    """Daily counts and sums to months; empty days add nothing."""
    return daily.groupBy(F.trunc("day", "month").alias("month")).agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_value")
    )


def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per-day event count and mean value through a stream."""
    base = run_dir(spark, "daily")
    run_counts(stream_counts(event_stream(spark, folder), F.col("value")), f"{base}/table", f"{base}/checkpoint")
    return latest_version(spark, f"{base}/table").select(
        F.col("w.start").cast("date").alias("day"), "n", "total"
    )


DAILY_KEYS = ["user_id", "event_type", "event_day"]


def _daily_keys(stream: DataFrame) -> DataFrame:
    return stream.withColumn("event_day", F.to_date("ts")).select("ts", *DAILY_KEYS)


def dedupe_daily(spark: SparkSession, folder: str) -> DataFrame:
    """First event per user, type and day through an insert-only stream."""
    base = run_dir(spark, "ingest")
    stream_ingest(
        _daily_keys(event_stream(spark, folder)), f"{base}/table", f"{base}/checkpoint", DAILY_KEYS, partition="event_day"
    )
    return spark.read.parquet(f"{base}/table").select("user_id", "event_type", F.col("event_day").cast("date"))


def late_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The same over events that arrive in three deliveries, the last days
    first, each with some rows of the one before once more."""
    base = run_dir(spark, "late")
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{folder}/events.parquet")
    day = F.dayofmonth("ts")
    for low, high in ((21, 31), (11, 23), (1, 13)):
        events.where(day.between(low, high)).write.mode("append").parquet(f"{base}/arrived")
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{base}/arrived")
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        stream_ingest(_daily_keys(stream), f"{base}/table", f"{base}/checkpoint", DAILY_KEYS, partition="event_day")
    rows = spark.read.parquet(f"{base}/table")
    return rows.select("user_id", "event_type", F.col("event_day").cast("date"), F.regexp_extract("run", r"\d+", 0).cast("long").alias("delivery"))
