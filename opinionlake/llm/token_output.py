"""Token ids on disk, compressed by a Re-Pair grammar per shard.

Documents are sorted by id over range partitions; each partition writes shards
of whole documents, in order. In a shard, frequent pairs of neighbouring
symbols are replaced by new symbols, round after round: all pairs that occur at
least ``least`` times (so often that a rule pays off) are replaced at once
(where two overlap, every other one of a run), until a round finds no such
pair. A pair never spans two documents, so a document begins at a symbol and
can be decoded by itself.

Shard layout, little-endian, one after the other:

    8 bytes     magic "REPAIR01"
    6 x int64   rules, symbols, documents, ids in the shard, 0, 0
    uint32 [2]  left and right symbol of each rule; rule i is symbol ALPHABET + i
    uint32      expansion length of each rule
    uint32      the symbols
    int64       id of each document (smallest number: null)
    int64       first symbol of each document, and the number of symbols
    int64       first id of each document in the shard, and the number of ids

The expansion lengths give the length of any run of symbols without expanding
it. Shards are rows (part, shard, ids, payload) of a Parquet table, so Spark's
commit protocol and any file system Spark can write to apply. No shard is
larger than ``shard_ids`` ids plus one document.

Cases: a null or empty text is the end id alone; null ids come first; rows that
share an id are ordered by text and kept as documents of their own; no rows
give no shards. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionlake.llm import tokens as K
from opinionlake.llm.registry import query, table
from opinionlake.session import run_dir

MAGIC = b"REPAIR01"
ALPHABET = 1 << 16
NO_ID = np.iinfo(np.int64).min
SHARDS = "part long, shard long, ids long, docs long, payload binary"


@dataclass(frozen=True)
class Settings:
    shard_ids: int = 1 << 20
    least: int = 24
    keep: int = 2_000_000  # chunks a worker remembers


class Grammar(NamedTuple):
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray


def _frequent(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes that occur at least ``least`` times, sorted; entries that are one of them; which one each of these is)."""
    # Counts by a hash bound the true ones from above, so few codes have to be sorted.
    hashed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    slot = hashed(codes)
    maybe = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= least)[slot])
    slot, codes = slot[maybe], codes[maybe]
    some, n = np.unique(codes, return_counts=True)
    found = some[n >= least]
    if not len(found):
        return found, maybe[:0], maybe[:0]
    # A slot names one of its codes; the others that share it are searched for.
    place, number = hashed(found), np.arange(len(found))
    name = np.zeros(1 << 20, np.int64)
    name[place] = number
    which = name[slot]
    hit = found[which] == codes
    shared = np.zeros(1 << 20, bool)
    shared[place[name[place] != number]] = True
    rest = np.flatnonzero(shared[slot] & ~hit)
    which[rest] = np.minimum(np.searchsorted(found, codes[rest]), len(found) - 1)
    hit[rest] = found[which[rest]] == codes[rest]
    return found, maybe[hit], which[hit]


def compress(ids: np.ndarray, starts: np.ndarray, s: Settings = Settings()) -> Grammar:
    """Grammar of the ids of several documents; ``starts`` is the first id of each."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    if len(symbols):
        last[np.append(starts[1:], len(symbols)) - 1] = True
    left, right, lengths = [], [], []
    size = np.ones(ALPHABET, np.int64)
    fresh = 0
    while len(symbols) > 1:
        # A pair of older symbols was rarer than that a round ago, and only gets rarer.
        new = symbols >= fresh
        inner = np.flatnonzero((new[:-1] | new[1:]) & ~last[:-1])
        codes = (symbols[inner].astype(np.uint64) << np.uint64(32)) | symbols[inner + 1]
        pairs, hit, rule = _frequent(codes, s.least)
        if not len(pairs):
            break
        at = inner[hit]
        # In a run of places one after the other, every second one is taken.
        begins = np.ones(len(at), bool)
        begins[1:] = at[1:] != at[:-1] + 1
        first = np.maximum.accumulate(np.where(begins, at, 0))
        taken = (at - first) % 2 == 0
        at, rule = at[taken], rule[taken]
        used = np.bincount(rule, minlength=len(pairs))
        keep = used >= 2
        if not keep.any():
            break
        fresh = len(size)
        number = np.cumsum(keep) - 1 + fresh
        at, rule = at[keep[rule]], rule[keep[rule]]
        chosen = pairs[keep]
        a, b = (chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32)
        left.append(a)
        right.append(b)
        size = np.concatenate([size, size[a] + size[b]])
        lengths.append((size[a] + size[b]).astype(np.uint32))
        symbols[at] = number[rule].astype(np.uint32)
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
    join = lambda x: np.concatenate(x).astype(np.uint32) if x else np.zeros(0, np.uint32)
    begins = np.append(0, np.flatnonzero(last) + 1).astype(np.int64)
    return Grammar(join(left), join(right), join(lengths), symbols, begins)


def _unfold(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids behind some symbols, one layer of rules after the other."""
    while len(symbols):
        big = symbols >= ALPHABET
        if not big.any():
            break
        out = np.empty(len(symbols) + int(big.sum()), np.uint32)
        at = np.arange(len(symbols)) + np.cumsum(big) - big
        rule = symbols[big] - np.uint32(ALPHABET)
        out[at[~big]] = symbols[~big]
        out[at[big]] = g.left[rule]
        out[at[big] + 1] = g.right[rule]
        symbols = out
    return symbols


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids behind some symbols. Many of them share the rules' ids, unfolded once; the expansion lengths say where."""
    if len(symbols) < len(g.left):
        return _unfold(g, symbols)
    flat = _unfold(g, np.arange(ALPHABET, ALPHABET + len(g.left), dtype=np.uint32))
    first = np.cumsum(g.lengths, dtype=np.int64) - g.lengths
    big = np.flatnonzero(symbols >= ALPHABET)
    rule = (symbols[big] - np.uint32(ALPHABET)).astype(np.int64)
    n = np.ones(len(symbols), np.int64)
    n[big] = g.lengths[rule]
    out = np.repeat(symbols, n)
    sizes = n[big]
    nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat((np.cumsum(n) - n)[big], sizes) + nth] = flat[np.repeat(first[rule], sizes) + nth]
    return out


def lengths_of(g: Grammar) -> np.ndarray:
    """Number of ids behind each symbol of the sequence."""
    out = np.ones(len(g.symbols), np.int64)
    big = g.symbols >= ALPHABET
    out[big] = g.lengths[g.symbols[big] - np.uint32(ALPHABET)]
    return out


def dump(docs: np.ndarray, ids: np.ndarray, starts: np.ndarray, s: Settings) -> bytes:
    """A shard's bytes."""
    g = compress(ids, starts, s)
    head = np.array([len(g.left), len(g.symbols), len(docs), len(ids), 0, 0], "<i8")
    parts = [
        head, np.stack([g.left, g.right], 1).astype("<u4"), g.lengths.astype("<u4"), g.symbols.astype("<u4"),
        docs.astype("<i8"), g.starts.astype("<i8"), np.append(starts, len(ids)).astype("<i8"),
    ]
    return MAGIC + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class Shard:
    """A shard read back; documents are decoded one by one or all at once."""

    def __init__(self, payload: bytes) -> None:
        if payload[:8] != MAGIC:
            raise ValueError("not a shard")
        rules, symbols, docs, self.ids, _, _ = np.frombuffer(payload, "<i8", 6, 8).tolist()
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        pairs = take("<u4", 2 * rules).reshape(-1, 2)
        lengths, line = take("<u4", rules), take("<u4", symbols)
        self.docs = take("<i8", docs)
        starts = take("<i8", docs + 1)
        self.first = take("<i8", docs + 1)
        self.grammar = Grammar(pairs[:, 0], pairs[:, 1], lengths, line, starts)

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, found by its place and decoded alone."""
        g = self.grammar
        return expand(g, g.symbols[g.starts[i] : g.starts[i + 1]])

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the shard; the expansion lengths tell which symbols hold them."""
        ends = np.cumsum(lengths_of(self.grammar))
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return expand(self.grammar, self.grammar.symbols[a:b])[start - before : stop - before]

    def all(self) -> np.ndarray:
        return expand(self.grammar, self.grammar.symbols)


def write(docs: DataFrame, folder: str, path: str | None = None, s: Settings = Settings()) -> None:
    """Write the ids of all documents, ascending by id, as shards below ``folder``."""
    path = path or K.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = K.encoder(path, s.keep), TaskContext.get().partitionId()
        keys: list[int] = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        number = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            n = np.array(sizes, np.int64)
            payload = dump(np.array(keys, np.int64), np.concatenate(parts), np.cumsum(n) - n, s)
            row = [[part], [number], [int(n.sum())], [len(keys)]]
            out = pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in row), pa.array([payload], pa.binary())],
                names=["part", "shard", "ids", "docs", "payload"],
            )
            number += 1
            for x in (keys, parts, sizes):
                x.clear()
            return out

        total = 0
        for batch in batches:
            names = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy()
            for rows, ids, per in encoder.column(batch.column("text")):
                with_end = np.insert(ids, np.cumsum(per), np.uint32(K.END))
                keys.extend(names[rows].tolist())
                sizes.extend((per + 1).tolist())
                parts.append(with_end)
                total += len(with_end)
                if total >= s.shard_ids:
                    total = 0
                    yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    in_order.mapInArrow(run, SHARDS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files; ``ids`` are little-endian 32-bit numbers."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    # One number per partition of the writer and per shard; the payloads stay where they are.
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select(
        F.col("part").alias("p"), F.col("shard").alias("s"),
        F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("in_part"),
    ).join(parts.withColumnRenamed("part", "p"), "p").select("p", "s", (F.col("part_start") + F.col("in_part")).alias("begin"))
    keyed = shards.join(places, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s"))).select("begin", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, payload in zip(batch.column("begin").to_pylist(), batch.column("payload"), strict=True):
                shard = Shard(payload.as_py())
                ids = shard.all().astype("<u4")
                cuts = shard.first.tolist()
                names = pa.array(shard.docs, pa.int64(), mask=shard.docs == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pa.array(shard.first[:-1] + begin, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "ids"],
                )

    return keyed.mapInArrow(run, "doc_id long, start long, ids binary")


@query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
