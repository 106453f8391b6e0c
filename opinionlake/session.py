"""Session helper for local runs and the shared folder for written state."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "opinionlake") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="opinionlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process, and so share its folders."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and everything runs in one
    process (tests) a temporary folder is made, and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not one_machine(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _own_dir()).rstrip("/")


_runs: set[str] = set()


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for a run's tables."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _runs.add(folder)
    return folder


def remove_dir(spark: SparkSession, folder: str) -> None:
    """Delete a run's folder once its result is written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _runs.discard(folder)


def remove_runs(spark: SparkSession) -> None:
    """Delete all run folders of this process. Tables read from them are gone
    afterwards, so call it when their results have been used."""
    for folder in sorted(_runs):
        remove_dir(spark, folder)
