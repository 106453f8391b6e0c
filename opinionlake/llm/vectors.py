"""Vector columns: rows that can take part, and their numbers as a matrix."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(col, dtype=np.float64) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1), dtype)


def takes_part(v: Column, fits: Callable[[Column], Column]) -> Column:
    """Whether a vector is there, has an entry, and all its entries are finite numbers that ``fits`` accepts."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & fits(x)
    return F.coalesce((F.size(v) > 0) & F.forall(v, fine), F.lit(False))


def same_length(base: DataFrame, v: str = "v") -> DataFrame | None:
    """Rows of the most frequent length (the shorter of equally frequent ones); None where there are none."""
    most = base.groupBy(F.size(v).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return None if most is None else base.where(F.size(v) == most["n"])


def staged(rows: DataFrame, vector: str, key: str, folder: str, fits: Callable[[Column], Column]) -> DataFrame | None:
    """(id, v) of the rows that take part, written once to ``folder``; None where there are none."""
    v = F.col(vector)
    wide = v.cast("array<double>")
    good = rows.where(takes_part(wide, fits)).select(F.col(key).alias("id"), v.alias("v"))
    good.write.parquet(f"{folder}/rows")
    return same_length(rows.sparkSession.read.schema(good.schema).parquet(f"{folder}/rows"))
