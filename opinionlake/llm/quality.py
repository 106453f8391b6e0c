"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each of its words and
character n-grams, found by hashing them into a fixed number of buckets; a word
that stood among the few words before it counts as one more feature, by its
distance. A softmax layer over that average gives the class. Vectors and layer are fitted
by stochastic gradient descent in numpy on a bounded number of labelled
documents (``per_class`` of each class, chosen by a hash of their id); scoring
covers every byte of every text.

At scoring time the average and the layer are both linear, so the layer is
applied to the bucket vectors once and a document's score is the mean of one
number per feature. No shuffle of texts: the fitted table (one float per
bucket, fixed size) is broadcast, and documents are scored where they are read.

Cases: a null or empty text has no feature and gets the score of the layer's
bias; a null ``doc_id`` is never learned from and is not held out; rows that
share an id are scored each on its own; labels with a null are not used. With
labels of one class only, or none, every score is that class's share (0.5 with
none). Extra columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.llm import bytesio as B
from opinionlake.llm.registry import query, table


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    grams: tuple[int, ...] = (3, 4)
    repeats: int = 8
    dim: int = 12
    per_class: int = 1500
    epochs: int = 6
    rate: float = 0.4
    seed: int = 7


@dataclass
class Model:
    """One number per bucket and a bias; the logit is their mean over a text's features plus the bias."""

    weights: np.ndarray = field(repr=False)
    bias: float
    settings: Settings


def to_bucket(hashes: np.ndarray, s: Settings) -> np.ndarray:
    shift = np.uint64(64 - s.buckets.bit_length() + 1)
    return ((hashes * B.GRAM) >> shift).astype(np.int32)


def features(block: B.Block, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, segment) of every word, every repeat and every n-gram inside a word with its borders.

    White space counts as a border character, the same for every kind of it.
    """
    data = np.where(B.WHITE[block.data], np.uint8(0x20), block.data)
    sums = B.prefix_sums(data)
    starts, ends, segment = B.word_bounds(block, B.WHITE)
    word = B.range_hash(sums, starts, ends)
    found = [(to_bucket(word, s), segment)]
    for back in range(1, s.repeats + 1):
        again = np.flatnonzero((word[back:] == word[:-back]) & (segment[back:] == segment[:-back]))
        found.append((np.full(len(again), back, np.int32), segment[again]))
    of = np.repeat(np.arange(len(block.rows), dtype=np.int32), block.ends - block.starts)
    _, down = B.powers(len(data) + 1)
    blank = data == 0x20
    for n in s.grams:
        m = len(data) - n + 1
        if m <= 0:
            continue
        whole = of[:m] == of[n - 1 :]
        for inner in range(1, n - 1):
            whole &= ~blank[inner : inner + m]
        at = np.flatnonzero(whole)
        gram = (sums[n:] - sums[:-n]) * down[:m]
        found.append((to_bucket(gram[at] + np.uint64(n), s), of[at]))
    return np.concatenate([h for h, _ in found]), np.concatenate([p for _, p in found])


def _bags(s: Settings):
    """Documents as (id, class, distinct buckets, counts), for fitting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                total: dict[int, int] = {}
                for block in B.blocks(batch.column("text").slice(i, 1), B.at_white):
                    ids, counts = np.unique(features(block, s)[0], return_counts=True)
                    for b, c in zip(ids.tolist(), counts.tolist(), strict=True):
                        total[b] = total.get(b, 0) + c
                ids = np.fromiter(total.keys(), np.int32, len(total))
                counts = np.fromiter(total.values(), np.float32, len(total))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(i, 1),
                        batch.column("label").slice(i, 1),
                        pa.array([ids.tobytes()], pa.binary()),
                        pa.array([counts.tobytes()], pa.binary()),
                    ],
                    names=["key", "label", "ids", "counts"],
                )

    return run


def sgd(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket vectors and softmax layer (with its bias as last row), one document per step."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    layer = np.zeros((s.dim + 1, 2), np.float32)
    steps, done = s.epochs * len(bags), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(bags)):
            rate = s.rate * (1 - done / steps)
            done += 1
            ids, share = bags[i]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(s.dim, np.float32)
            z = hidden @ layer[:-1] + layer[-1]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer[:-1] @ p
            layer[:-1] -= rate * np.outer(hidden, p)
            layer[-1] -= rate * p
            if len(ids):
                # Shares are small, so a vector moves by its share relative to the largest one.
                vectors[ids] -= rate * np.outer(share / share.max(), back)
    return vectors, layer


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from labelled documents whose crc32(id as text) mod 3 is not 1."""
    usable = labels.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & (F.crc32(F.col("key").cast("string")) % 3 != 1)
    )
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(next(iter(counts)))
        bias = {0.5: 0.0, 0.0: -4.0, 1.0: 4.0}[share]
        return Model(np.zeros(s.buckets, np.float32), bias, s)
    # About per_class documents of each class: those whose hash is below the class's share of the range.
    part = F.lit(0.0)
    for label, n in counts.items():
        part = F.when(F.col("label") == label, min(1.0, s.per_class / n)).otherwise(part)
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(usable.where(draw < part).dropDuplicates())
    rows = (
        docs.select(F.col("doc_id").alias("key"), "text")
        .join(chosen, "key")
        .select("key", "label", "text")
        .mapInArrow(B.lean(_bags(s)), "key long, label int, ids binary, counts binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["key"], r["label"], r["ids"], r["counts"]))
    bags = []
    for r in rows:
        n = np.frombuffer(r["counts"], np.float32)
        bags.append((np.frombuffer(r["ids"], np.int32), n / max(n.sum(), 1)))
    y = np.array([r["label"] for r in rows], np.int64)
    vectors, layer = sgd(bags, y, s)
    flat = vectors @ (layer[:-1, 1] - layer[:-1, 0])
    # The sample holds as many of each class; the bias moves back to the shares of all labels.
    shown = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    prior = np.log(counts[1] / counts[0]) - np.log(shown[1] / shown[0])
    return Model(flat, float(layer[-1, 1] - layer[-1, 0] + prior), s)


def scores(col, model: Model) -> np.ndarray:
    """Score of each text of an Arrow column: the softmax output for class 1."""
    total = np.zeros(len(col))
    count = np.zeros(len(col))
    for block in B.blocks(col, B.at_white):
        bucket, segment = features(block, model.settings)
        k = len(block.rows)
        total[block.rows] += np.bincount(segment, weights=model.weights[bucket], minlength=k)
        count[block.rows] += np.bincount(segment, minlength=k)
    z = np.clip(total / np.maximum(count, 1) + model.bias, -30, 30)
    return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(batch.column("text"), held.value))], names=["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(B.lean(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is at least ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place), held.value) >= least))

    return docs.mapInArrow(B.lean(run), docs.schema)


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    return score(docs, model).select(
        "doc_id",
        F.coalesce(third == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
