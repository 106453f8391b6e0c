"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths run over them, each filter keeps
its largest response in a window (max pooling), and a softmax layer over those
gives the language. The network is trained in numpy on windows of a bounded
number of labelled documents (``per_language`` of each, chosen by a hash of the
id; with more than ``languages`` languages fewer of each, but at least one, so
that every language can be predicted). It is applied to consecutive windows of fixed length that cover a whole
text, many windows at once; a document's log-probabilities are the average over
its windows, weighted by their bytes.

Texts are scored where they are read: nothing is shuffled, and the broadcast
network has a fixed size.

Cases: a null text, an empty one or one without a letter gives ``und`` with
score 0, as does every text when nothing can be learned; a null language or a
null id is never learned from; a null id is not held out; rows that share an id
are scored each on its own; a tie goes to the language first in the alphabet.
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
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    dim: int = 8
    per_language: int = 400
    languages: int = 200
    windows_per_text: int = 6
    epochs: int = 6
    batch: int = 32
    rate: float = 0.004
    together: int = 64
    seed: int = 11


# Log-probabilities that are held at once.
CELLS = 1 << 22


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray = field(repr=False)
    filters: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    layer: np.ndarray = field(repr=False)
    settings: Settings


def windows(block: B.Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in rows of ``size``, segment, bytes used) of each window; the last one of a text is filled with zeros."""
    length = block.ends - block.starts
    n = -(-length // size)
    segment = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    start = block.starts[segment] + nth * size
    used = np.minimum(size, block.ends[segment] - start)
    at = start[:, None] + np.arange(size)
    inside = np.arange(size) < used[:, None]
    out = np.zeros(at.shape, np.uint8)
    out[inside] = block.data[at[inside]]
    return out, segment, used


def _columns(embed: np.ndarray, data: np.ndarray, reach: int) -> np.ndarray:
    """Embedded bytes side by side for every place: (windows, places, reach * dim)."""
    x = np.ascontiguousarray(embed[data])
    n, size, dim = x.shape
    a, b, c = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, size - reach + 1, reach * dim), (a, b, c))


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def forward(net: Network, data: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages for each window."""
    s = net.settings
    out = np.empty((len(data), len(net.languages)), np.float32)
    for i in range(0, len(data), s.together):
        part = data[i : i + s.together]
        cols = _columns(net.embed, part, max(s.widths))
        flat = cols.reshape(-1, cols.shape[2]) @ net.filters
        pooled = np.maximum(flat.reshape(len(part), cols.shape[1], -1).max(axis=1) + net.bias, 0)
        out[i : i + s.together] = log_softmax(pooled @ net.layer[:-1] + net.layer[-1])
    return out


def train(data: np.ndarray, y: np.ndarray, languages: list[str], s: Settings) -> Network:
    """Adam on the cross-entropy; a filter's gradient flows to the place of its largest response only."""
    rng = np.random.default_rng(s.seed)
    reach, total = max(s.widths), s.filters * len(s.widths)
    allowed = np.zeros((reach * s.dim, total), np.float32)
    for k, width in enumerate(s.widths):
        allowed[: width * s.dim, k * s.filters : (k + 1) * s.filters] = 1
    p = {
        "embed": rng.normal(0, 0.5, (256, s.dim)).astype(np.float32),
        "filters": (rng.normal(0, 0.3, allowed.shape) * allowed).astype(np.float32),
        "bias": np.zeros(total, np.float32),
        "layer": np.vstack([rng.normal(0, 0.2, (total, len(languages))), np.zeros((1, len(languages)))]).astype(np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), s.batch):
            pick = order[i : i + s.batch]
            x = data[pick].copy()
            # Some windows are shortened, as the texts to come may be.
            for j in np.flatnonzero(rng.random(len(pick)) < 0.3):
                x[j, rng.integers(8, s.window) :] = 0
            cols = _columns(p["embed"], x, reach)
            n, places, wide = cols.shape
            response = (cols.reshape(-1, wide) @ p["filters"]).reshape(n, places, total)
            best = response.argmax(axis=1)
            pooled = np.take_along_axis(response, best[:, None, :], 1)[:, 0] + p["bias"]
            hidden = np.maximum(pooled, 0)
            z = np.exp(log_softmax(hidden @ p["layer"][:-1] + p["layer"][-1]))
            z[np.arange(n), y[pick]] -= 1
            z /= n
            back = (z @ p["layer"][:-1].T) * (pooled > 0)
            seen = cols[np.arange(n)[:, None], best]
            g = {
                "layer": np.vstack([hidden.T @ z, z.sum(axis=0, keepdims=True)]),
                "bias": back.sum(axis=0),
                "filters": np.einsum("nfk,nf->kf", seen, back) * allowed,
                "embed": np.zeros_like(p["embed"]),
            }
            to_embed = (p["filters"].T[None] * back[:, :, None]).reshape(n, total, reach, s.dim)
            chars = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(reach)]
            np.add.at(g["embed"], chars.ravel(), to_embed.reshape(-1, s.dim))
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                p[k] -= s.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["embed"], p["filters"], p["bias"], p["layer"], s)


def _samples(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, found = [], [], []
            for i in range(batch.num_rows):
                data, at = B.column_bytes(batch.column("text").slice(i, 1))
                text = data[at[0] : at[1]]
                last = max(0, -(-len(text) // s.window) - 1)
                for k in np.unique(np.linspace(0, last, s.windows_per_text).astype(int)).tolist():
                    keys.append(batch.column("key")[i].as_py())
                    names.append(batch.column("lang")[i].as_py())
                    found.append(text[k * s.window : (k + 1) * s.window].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(found, pa.binary())],
                names=["key", "lang", "bytes"],
            )

    return run


def fit(docs: DataFrame, s: Settings = Settings()) -> Network | None:
    """Learn from documents with a language whose crc32(id as text) mod 4 is not 2; None if there are none."""
    usable = docs.select(F.col("doc_id").alias("key"), "lang").where(
        F.col("lang").isNotNull() & (F.crc32(F.col("key").cast("string")) % 4 != 2)
    )
    common = usable.groupBy("lang").agg(F.count("*").alias("n"))
    many = common.count()
    per_language, lettered = float(s.per_language), F.col("text").rlike(r"\p{L}")
    taken = F.lit(False)
    if many > s.languages:
        # Fewer documents of each language, but at least one of every language that has any with a letter.
        per_language = max(1.0, per_language * s.languages / many)
        least = docs.select(F.col("doc_id").alias("key"), "lang", "text").where(
            F.col("lang").isNotNull() & lettered & (F.crc32(F.col("key").cast("string")) % 4 != 2)
        )
        common = common.join(least.groupBy("lang").agg(F.min_by("key", F.xxhash64("key")).alias("least")), "lang")
        taken = F.col("key") == F.col("least")
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    rows = (
        docs.select(F.col("doc_id").alias("key"), "lang", "text")
        .where(lettered & (F.crc32(F.col("key").cast("string")) % 4 != 2))
        .join(F.broadcast(common), "lang")
        .where((draw < F.least(F.lit(1.0), F.lit(per_language) / F.col("n"))) | taken)
        .select("key", "lang", "text")
        .mapInArrow(_samples(s), "key long, lang string, bytes binary")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r["key"], r["lang"], r["bytes"]))
    languages = sorted({r["lang"] for r in rows})
    place = {name: i for i, name in enumerate(languages)}
    data = np.zeros((len(rows), s.window), np.uint8)
    for i, r in enumerate(rows):
        data[i, : len(r["bytes"])] = np.frombuffer(r["bytes"], np.uint8)
    return train(data, np.array([place[r["lang"]] for r in rows]), languages, s)


def log_probabilities(col, net: Network) -> np.ndarray:
    """Average log-probabilities of each text of an Arrow column, windows weighted by their bytes."""
    total = np.zeros((len(col), len(net.languages)))
    weight = np.zeros(len(col))
    for block in B.blocks(col):
        data, segment, used = windows(block, net.settings.window)
        if not len(data):
            continue
        given = forward(net, data) * used[:, None]
        row = block.rows[segment]
        np.add.at(total, row, given)
        weight += np.bincount(row, weights=used, minlength=len(col))
    return log_softmax(total / np.maximum(weight, 1)[:, None])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*held.value.languages, "und"], object)
        # With very many languages, few texts at once.
        some = max(1, CELLS // len(names))
        for batch in (b.slice(i, some) for b in batches for i in range(0, max(1, b.num_rows), some)):
            known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            logs = log_probabilities(batch.column("text"), held.value)
            best = np.where(known, logs.argmax(axis=1), len(names) - 1)
            sure = np.where(known, np.exp(logs.max(axis=1)), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.minimum(sure, 1.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    quarter = F.crc32(F.col("doc_id").cast("string")) % 4
    return predict(docs, fit(docs)).select(
        "doc_id", F.coalesce(quarter == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
