"""Embedding whitening with an exact covariance from bit planes.

Each entry c becomes the integer x = floor(64 c) + 1000000. A dimension's
integers, shifted by their minimum, need few bits; a block of rows is turned
into bit planes, one bit per row, packed into 64-bit words. The sum of products
of two dimensions is then

    sum over planes a, b of 2^(a + b) * popcount(plane_a AND plane_b),

exact whatever the order of rows or tasks. Sums of shifted products are centred
as integers, n * sum(xy) - sum(x) * sum(y), which no shift changes, and only the
finished covariance becomes double, correctly rounded, before ``eigh``.

Tasks read their rows and return numbers by pair of dimensions, which Spark
adds; the driver sees one matrix of dimensions by dimensions, whatever the
number of rows. The staged vectors are read four times: bounds, planes, the
check of the whitened covariance, and the result.

Cases: vectors that are null, empty or hold a null, a non-finite number or one
whose x is no 64-bit integer take no part, nor do those of another length than
the most frequent one (the shorter of equally frequent ones). Repeated rows and
rows that share an id count and are returned each; a null id is returned as
null. A component without variance (eigenvalue zero up to rounding) has a null
``whitened``; where all vectors are equal, ``explained`` is null too, and
``identity_error`` is null if no component has variance. A deviation beyond 64
bits is null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.llm.registry import query, table
from opinionlake.llm.vectors import matrix, staged
from opinionlake.session import run_dir

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
# Rows that are turned into planes, or projected, at once.
BLOCK = 1 << 13
SLICE = 1 << 11
# A sum of products travels as four digits of this many bits.
DIGIT = 40


def integers(m: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * m).astype(np.int64) + OFFSET


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of the columns of y (not negative), column after column, low bits first: rows packed into words."""
    rows = -(-len(y) // 64) * 64
    out = np.zeros((int(bits.sum()), rows // 8), np.uint8)
    at = 0
    for column, n in zip(y.T, bits.tolist(), strict=True):
        for b in range(n):
            packed = np.packbits(((column >> b) & 1).astype(bool))
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def overlaps(p: np.ndarray) -> np.ndarray:
    """How many rows have a bit in both of two planes, for all pairs of planes."""
    out = np.zeros((len(p), len(p)), np.int64)
    for i in range(len(p)):
        out[i, i:] = np.bitwise_count(p[i] & p[i:]).sum(axis=1, dtype=np.int64)
    return out


def products(counts: np.ndarray, bits: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of shifted integers from the overlaps of their planes, exact."""
    whole = counts + np.triu(counts, 1).T
    dims = np.repeat(np.arange(len(bits)), bits)
    place = np.arange(len(dims)) - np.repeat(np.cumsum(bits) - bits, bits)
    fits = 2 * int(bits.max(initial=0)) + rows.bit_length() < 62
    weigh = np.zeros((len(bits), len(dims)), np.int64 if fits else object)
    weigh[dims, np.arange(len(dims))] = [1 << int(b) for b in place] if not fits else 1 << place
    whole = whole if fits else whole.astype(object)
    return weigh @ np.diag(whole), weigh @ whole @ weigh.T


def digits(value: int) -> list[int]:
    mask = (1 << DIGIT) - 1
    return [(value >> (DIGIT * i)) & mask for i in range(4)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield integers(matrix(batch.column("v").slice(lo, BLOCK)))


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, lo, hi = 0, None, None
    for x in _blocks(batches):
        n += len(x)
        lo = x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))
        hi = x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0))
    if n:
        columns = [np.arange(len(lo)), np.full(len(lo), n), lo, hi]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "n", "lo", "hi"])


def _scatter(low: np.ndarray, bits: np.ndarray):
    """Sums (j = -1) and sums of products of this task's shifted integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((int(bits.sum()),) * 2, np.int64), 0
        for x in _blocks(batches):
            counts += overlaps(planes(x - low, bits))
            rows += len(x)
        if not rows:
            return
        sums, cross = products(counts, bits, rows)
        i, j = np.triu_indices(len(bits))
        parts = np.array([digits(int(v)) for v in [*sums, *cross[i, j]]], np.int64).T
        first = [np.append(np.arange(len(bits)), i), np.append(np.full(len(bits), -1), j)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in [*first, *parts]], names=["i", "j", "d0", "d1", "d2", "d3"])

    return run


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` vectors, per-dimension minimum ``low`` and sums of x - low, ``total`` of squared
    deviations, eigenvalues falling, eigenvectors as columns; ``rank`` of them have variance."""

    n: int
    low: np.ndarray
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    rank: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) - np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened components of integer rows; NaN where there is no variance."""
        k = min(k, len(self.values))
        scale = np.full(k, np.nan)
        used = min(k, self.rank)
        scale[:used] = 1 / np.sqrt(self.values[:used])
        return (self.centred(x) @ self.vectors[:, :k]) * scale

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum over dimensions of (n x - S)^2, whether it fits): arithmetic modulo 2^64 is exact for what fits."""
        wrap = lambda v: ((v + (1 << 63)) % (1 << 64)) - (1 << 63)
        d = np.int64(wrap(self.n)) * (x - self.low) - np.array([wrap(s) for s in self.sums], np.int64)
        about = ((self.n * self.centred(x)) ** 2).sum(axis=1)
        return (d * d).sum(axis=1), about < 0.999 * 2.0**63


def fit(rows: DataFrame) -> Whitening | None:
    """From staged rows with a vector column ``v``; None where there are none."""
    bounds = rows.mapInArrow(_bounds, "i long, n long, lo long, hi long").groupBy("i").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).orderBy("i").collect()  # one row a dimension
    if not bounds:
        return None
    n, low = bounds[0]["n"], np.array([r["lo"] for r in bounds], np.int64)
    bits = np.array([(r["hi"] - r["lo"]).bit_length() for r in bounds], np.int64)
    d = len(bits)
    names = ["d0", "d1", "d2", "d3"]
    found = rows.mapInArrow(_scatter(low, bits), "i long, j long, " + ", ".join(f"{c} long" for c in names))
    sums, cross = [0] * d, [[0] * d for _ in range(d)]
    for r in found.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect():  # one row a pair of dimensions
        value = sum(r[c] << (DIGIT * k) for k, c in enumerate(names))
        if r["j"] < 0:
            sums[r["i"]] = value
        else:
            cross[r["i"]][r["j"]] = cross[r["j"]][r["i"]] = value
    centred = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    # Dividing whole numbers rounds once.
    values, vectors = np.linalg.eigh(np.array([[c / (n * n) for c in line] for line in centred]))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    rank = int((values > d * np.finfo(float).eps * max(values[0], 0)).sum())
    return Whitening(n, low, tuple(sums), values, vectors, sum(centred[i][i] for i in range(d)) / (n * n), rank)


def identity_error(rows: DataFrame, model: Whitening, k: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, as measured on the rows."""
    used = min(k, model.rank)
    if not used:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((used, used))
        for x in _blocks(batches):
            w = model.project(x, used)
            total += w.T @ w
        i, j = np.triu_indices(used)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j])], names=["i", "j", "s"])

    found = rows.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    off = F.abs(F.col("s") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return found.agg(F.max(off).alias("e")).first()["e"]


RESULT = "vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def components(rows: DataFrame, model: Whitening, error: float | None, k: int = COMPONENTS) -> DataFrame:
    """One row per staged row and component, as in ``RESULT``."""
    kind = rows.schema["id"].dataType.simpleString()
    k = min(k, len(model.values))
    explained = [v / model.trace if model.trace else None for v in model.values[:k].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                n = some.num_rows
                x = integers(matrix(some.column("v")))
                deviation, fits = model.deviation(x)
                w = model.project(x, k).ravel()
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                        pa.array(np.full(n * k, model.n), pa.int64()),
                        pa.array(deviation, pa.int64(), mask=~fits).take(each),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(explained * n, pa.float64()),
                        pa.array([error] * (n * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, RESULT.format(key=kind))


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """Fits all vectors of ``rows`` and returns their components."""
    spark = rows.sparkSession
    fits = lambda x: (x * SCALE >= -(2.0**62)) & (x * SCALE <= 2.0**62)
    base = staged(rows, vector, key, run_dir(spark, "whitening"), fits)
    model = fit(base) if base is not None else None
    if model is None:
        return spark.createDataFrame([], RESULT.format(key=rows.schema[key].dataType.simpleString()))
    return components(base, model, identity_error(base, model, k), k)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
