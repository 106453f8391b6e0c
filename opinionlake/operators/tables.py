"""Keyed tables kept up to date on plain Parquet: snapshots, copy on write.

Rows are dealt into buckets by a hash of their key; each bucket is a folder of
Parquet files, and a manifest names the folders of one snapshot:

    data/<write>/bucket=<n>/*.parquet     rows of a bucket, as one write left them
    snapshots/<version>.json              key, number of buckets, schema, folder of each bucket

A change reads and rewrites only the buckets its keys fall into. The others keep
their files, and the new manifest names them as before. A manifest is written
under another name and renamed into place, which fails if that version is
there: of two writers one wins, and the other raises and changes nothing.
Readers take the folders of one manifest, so a change never alters what a reader
of an older snapshot sees, until ``vacuum`` removes the files that only older
snapshots name. A write that broke off leaves files that no manifest names.

Rows without a key are not stored. The driver handles one name per bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.operators.ranking import first_by

BUCKET = "_bucket"


class ConcurrentChange(RuntimeError):
    """Another writer has made this version in the meantime."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    key: str
    buckets: int
    schema: T.StructType
    folders: dict[int, str]

    def text(self) -> str:
        named = {str(b): f for b, f in sorted(self.folders.items())}
        return json.dumps({"key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(), "folders": named})


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the table, rising; empty where there is none."""
    fs, at = _files(spark, f"{path}/snapshots")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or the given one."""
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no snapshot {'' if version is None else version} at {path}")
    version = known[-1] if version is None else version
    text = spark.read.text(f"{path}/snapshots/{version}.json", wholetext=True).first()["value"]
    held = json.loads(text)
    folders = {int(b): f for b, f in held["folders"].items()}
    return Snapshot(version, held["key"], held["buckets"], T.StructType.fromJson(held["schema"]), folders)


def _commit(spark: SparkSession, path: str, made: Snapshot) -> None:
    fs, to = _files(spark, f"{path}/snapshots/{made.version}.json")
    _, draft = _files(spark, f"{path}/snapshots/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(made.text().encode()))
    out.close()
    if fs.exists(to) or not fs.rename(draft, to):
        fs.delete(draft, False)
        raise ConcurrentChange(f"version {made.version} of {path} is there already")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def _write(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int) -> dict[int, str]:
    """Writes rows by bucket; the folder of each bucket that has any."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn(BUCKET, _bucket(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    fs, at = _files(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def create(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int = 64) -> Snapshot:
    """A new table from ``rows``; keys are unique and not null there."""
    rows = rows.where(F.col(key).isNotNull())
    made = Snapshot(0, key, buckets, rows.schema, _write(spark, path, rows, key, buckets))
    _commit(spark, path, made)
    return made


def _rows(spark: SparkSession, path: str, held: Snapshot, only: list[int] | None = None) -> DataFrame:
    folders = [f"{path}/{f}" for b, f in sorted(held.folders.items()) if only is None or b in only]
    return spark.read.schema(held.schema).parquet(*folders) if folders else spark.createDataFrame([], held.schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _rows(spark, path, snapshot(spark, path, version))


def find(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of the given keys; only their buckets are read."""
    held = snapshot(spark, path)
    keys = wanted.select(held.key).distinct()
    return _rows(spark, path, held, _touched(keys, held)).join(keys, held.key, "left_semi")


def _touched(keys: DataFrame, held: Snapshot) -> list[int]:
    found = keys.where(F.col(held.key).isNotNull()).select(_bucket(held.key, held.buckets)).distinct()
    return [r[BUCKET] for r in found.collect()]  # at most one row per bucket


def _change(spark: SparkSession, path: str, keys: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> Snapshot:
    """The next snapshot, in which the buckets of ``keys`` hold what ``merge`` makes of their rows."""
    held = snapshot(spark, path)
    touched = _touched(keys, held)
    if not touched:
        return held
    merged = merge(_rows(spark, path, held, touched)).select(*held.schema.names)
    kept = {b: f for b, f in held.folders.items() if b not in touched}
    made = replace(held, version=held.version + 1, folders=kept | _write(spark, path, merged, held.key, held.buckets))
    _commit(spark, path, made)
    return made


def upsert(spark: SparkSession, path: str, changes: DataFrame, order: str) -> Snapshot:
    """The latest change per key applied, new keys added."""
    held = snapshot(spark, path)
    latest = first_by(changes.where(F.col(held.key).isNotNull()), [held.key], [F.col(order).desc()]).select(*held.schema.names)
    return _change(spark, path, changes, lambda old: old.join(latest.select(held.key), held.key, "left_anti").unionByName(latest))


def update(spark: SparkSession, path: str, changes: DataFrame, order: str, fields: list[str]) -> Snapshot:
    """The given fields of the latest change per known key; unknown keys change nothing."""
    held = snapshot(spark, path)
    latest = first_by(changes.where(F.col(held.key).isNotNull()), [held.key], [F.col(order).desc()])
    new = latest.select(held.key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_known"))
    put = {f: F.when(F.col("_known"), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    return _change(spark, path, changes, lambda old: old.join(new, held.key, "left").withColumns(put))


def delete(spark: SparkSession, path: str, keys: DataFrame) -> Snapshot:
    """Rows of the given keys removed."""
    held = snapshot(spark, path)
    gone = keys.select(held.key).distinct()
    return _change(spark, path, gone, lambda old: old.join(gone, held.key, "left_anti"))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all but the last ``keep`` snapshots and the files only they name; how many folders went.

    Not to be run while a writer is at work: files of a write without a manifest go too.
    """
    known = versions(spark, path)
    if not known:
        return 0
    kept = known[-max(1, keep) :]
    named = {f for v in kept for f in snapshot(spark, path, v).folders.values()}
    for v in known[: -len(kept)]:
        fs, at = _files(spark, f"{path}/snapshots/{v}.json")
        fs.delete(at, False)
    gone = 0
    fs, at = _files(spark, f"{path}/data")
    for write in [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []:
        parts = [s.getPath() for s in fs.listStatus(write) if s.isDirectory()]
        drop = [p for p in parts if f"data/{write.getName()}/{p.getName()}" not in named]
        for p in [write] if len(drop) == len(parts) else drop:
            fs.delete(p, True)
        gone += len(drop)
    return gone
