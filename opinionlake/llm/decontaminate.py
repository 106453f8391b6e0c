"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m bytes that stands in a text with at most k edits shares
at least m - q + 1 - k * q of its q-grams with the text there, and the places
of the shared q-grams differ by at most k in their diagonal (place in the text
minus place in the item). So the q-grams of every text are looked up in an
index of the items' q-grams, hits are counted in bands of 2 (k + 1) diagonals,
each overlapping the next by half, and a region is kept where a band reaches
the bound. Regions are verified by a banded alignment: the item against the
region, both ends free in the text.

Texts and items are compared in lower case with every run of bytes that are
neither letters nor digits as one space. The edit budget is a share of the
item's length (``rate``).

The index of the items is broadcast, in parts of about ``part_bytes`` bytes of
item text (a byte takes some 30 in the index), one part at a time: its result is
written to the run folder and its broadcast given up before the next part is
built, so neither the driver nor an executor ever holds more than one. With
more parts the texts are read once per part. Texts are searched where they are
read, whole and without a shuffle; a long text goes through in overlapping pieces.

Cases: null or empty texts and items match nothing, nor do items of fewer than
q bytes after reduction; items with equal id and text count once; rows that
share an id are searched each on its own. ``find`` ignores extra columns,
``drop_leaks`` keeps them.
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
from opinionlake.session import remove_dir, run_dir


@dataclass(frozen=True)
class Settings:
    q: int = 8
    rate: float = 0.08
    part_bytes: int = 2 << 20


_WORDS = B.byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_REDUCE = np.where(_WORDS[B.LOWER], B.LOWER, np.uint8(0x20))


def reduced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reduced bytes, their places in the text)."""
    low = _REDUCE[data]
    keep = low != 0x20
    keep[1:] |= low[:-1] != 0x20
    at = np.flatnonzero(keep)
    return low[at], at


@dataclass
class Index:
    """Distinct q-gram hashes of the items, and where each one occurs."""

    ids: list[int | None]
    texts: list[np.ndarray] = field(repr=False)
    budget: np.ndarray = field(repr=False)
    bound: np.ndarray = field(repr=False)
    hashes: np.ndarray = field(repr=False)
    first: np.ndarray = field(repr=False)
    item: np.ndarray = field(repr=False)
    place: np.ndarray = field(repr=False)
    maybe: np.ndarray = field(repr=False)
    q: int = 8


_SHIFT = np.uint64(64 - 24)


def _gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = B.prefix_sums(data)
    _, down = B.powers(len(data) + 1)
    return (sums[q:] - sums[:-q]) * down[:n] * B.GRAM


def build(items: list[tuple[int | None, str]], s: Settings) -> Index:
    ids, texts, budget, bound, hashes, item, place = [], [], [], [], [], [], []
    for key, text in items:
        body, _ = reduced(np.frombuffer(text.encode(), np.uint8))
        body = np.frombuffer(body.tobytes().strip(b" "), np.uint8)
        m = len(body)
        if m < s.q:
            continue
        k = min(int(s.rate * m), (m - s.q) // s.q)
        h = _gram_hashes(body, s.q)
        hashes.append(h)
        item.append(np.full(len(h), len(ids)))
        place.append(np.arange(len(h)))
        ids.append(key)
        texts.append(body)
        budget.append(k)
        bound.append(m - s.q + 1 - k * s.q)
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    distinct, first = np.unique(every[order], return_index=True)
    maybe = np.zeros(1 << 24, bool)
    maybe[distinct >> _SHIFT] = True
    pick = lambda parts: (np.concatenate(parts) if parts else np.zeros(0, np.int64))[order]
    return Index(
        ids, texts, np.array(budget, np.int64), np.array(bound, np.int64), distinct,
        np.append(first, len(every)), pick(item), pick(place), np.packbits(maybe, bitorder="little"), s.q,
    )


def align(item: np.ndarray, regions: list[np.ndarray], before: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of the item against any part of each region, and where that part ends.

    All regions at once, one row of the alignment per byte of the item; a cell is an offset (diagonal) of the region.
    A region has ``span`` bytes, of which ``before`` were clipped at its left and what else is missing at its right.
    """
    m = len(item)
    width = max(span - m, 1) + 1
    # Where a region was clipped stand bytes that equal nothing, so that diagonals that leave the text there exist.
    text = np.full((len(regions), m + width), 256, np.int16)
    for i, r in enumerate(regions):
        text[i, before[i] : before[i] + len(r)] = r
    size = before[:, None] + np.array([len(r) for r in regions])[:, None]
    offset = np.arange(width, dtype=np.int32)
    cost = np.zeros((len(regions), width), np.int32)
    big = np.int32(1 << 20)
    for i in range(m):
        new = cost + (text[:, i : i + width] != item[i])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - offset, axis=1) + offset
        # A cell that has used more bytes than the region holds is not there.
        cost = np.where(i + 1 + offset > size, np.minimum(cost + 1, big), cost) if width > 1 else cost
    best = cost.argmin(axis=1)
    return cost[np.arange(len(regions)), best], np.minimum(m + best, size[:, 0]) - before


def _regions(data: np.ndarray, row: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, row, from, to) of the regions that reach the bound in a band."""
    h = _gram_hashes(data, index.q)
    code = h >> _SHIFT
    at = np.flatnonzero((index.maybe[code >> np.uint64(3)] >> (code & np.uint64(7)).astype(np.uint8)) & 1)
    at = at[row[at] == row[at + index.q - 1]]
    if not len(at):
        return []
    slot = np.searchsorted(index.hashes, h[at])
    slot[slot == len(index.hashes)] = 0
    hit = index.hashes[slot] == h[at]
    at, slot = at[hit], slot[hit]
    times = index.first[slot + 1] - index.first[slot]
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    posting = np.repeat(index.first[slot], times) + nth
    at = np.repeat(at, times)
    item = index.item[posting]
    wide = index.budget[item] + 1
    reach = max(len(t) for t in index.texts)
    band = (at - index.place[posting] + reach) // wide
    bands = len(data) + reach + 2
    rows = int(row[-1]) + 1
    key = (item * rows + row[at]) * bands
    keys, counts = np.unique(np.concatenate([key + band, key + np.maximum(band - 1, 0)]), return_counts=True)
    pair, band = keys // bands, keys % bands
    item, row_of = pair // rows, pair % rows
    good = np.flatnonzero(counts >= index.bound[item])
    found = []
    for i in good.tolist():
        k = int(index.budget[item[i]])
        lo = int(band[i]) * (k + 1) - reach
        found.append((int(item[i]), int(row_of[i]), lo - k, lo + 2 * (k + 1) + len(index.texts[item[i]]) + k))
    return found


def leaks(col, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start byte, end byte) of the best match of each item in each text of an Arrow column."""
    if not index.ids:
        return []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    overlap = 2 * max(len(t) for t in index.texts)
    tail: tuple[int, np.ndarray, np.ndarray, int] | None = None
    for block in B.blocks(col, B.at_white):
        parts, places, rows = [], [], []
        low = _REDUCE[block.data]
        keep = low != 0x20
        keep[1:] |= low[:-1] != 0x20
        row0 = int(block.rows[0])
        single = len(block.rows) == 1
        goes_on = single and tail is not None and tail[0] == row0
        if goes_on and len(tail[1]) and tail[1][-1] != 0x20:
            keep[:1] = True
        at = np.flatnonzero(keep)
        of = np.repeat(np.arange(len(block.rows)), block.ends - block.starts)[at]
        place = at - block.starts[of]
        base = 0
        if goes_on:
            base = tail[3]
            parts, places, rows = [tail[1]], [tail[2]], [np.zeros(len(tail[1]), np.int64)]
        parts.append(low[at])
        places.append(place + base)
        rows.append(of)
        data, place, row = np.concatenate(parts), np.concatenate(places), np.concatenate(rows)
        if single:
            tail = (row0, data[-overlap:], place[-overlap:], base + len(block.data))
        if len(data) < index.q:
            continue
        edges = np.searchsorted(row, np.arange(len(block.rows) + 1))
        by_item: dict[int, list[tuple[int, int, int, int]]] = {}
        for item, r, begin, end in _regions(data, row, index):
            lo, hi = max(begin, int(edges[r])), min(end, int(edges[r + 1]))
            if hi - lo >= len(index.texts[item]) - index.budget[item]:
                by_item.setdefault(item, []).append((r, lo, hi, lo - begin))
        for item, spots in by_item.items():
            body = index.texts[item]
            span = len(body) + 4 * int(index.budget[item]) + 2
            for j in range(0, len(spots), 256):
                some = spots[j : j + 256]
                before = np.array([gap for *_, gap in some])
                cost, ends = align(body, [data[lo:hi] for _, lo, hi, _ in some], before, span)
                for (r, lo, *_), c, e in zip(some, cost.tolist(), ends.tolist(), strict=True):
                    if c <= index.budget[item]:
                        stop = lo + e
                        start = max(lo, stop - len(body))
                        key = (int(block.rows[r]), item)
                        found = (c, int(place[start]), int(place[stop - 1]) + 1)
                        best[key] = min(best.get(key, found), found)
    return [(row, item, *found) for (row, item), found in sorted(best.items())]


def indexes(items: DataFrame, s: Settings) -> tuple[int, Iterator[Index]]:
    """How many parts of about ``part_bytes`` bytes of item text there are, and their indexes, each built when asked for."""
    usable = items.select("item_id", "text").where(F.col("text") != "").distinct()
    size = usable.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // s.part_bytes))

    def each() -> Iterator[Index]:
        for i in range(parts):
            mine = usable.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i)
            yield build(sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=repr), s)

    return parts, each()


FOUND = "doc_id long, item_id long, edits long, similarity double, start_byte long, end_byte long"


def find(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document row and benchmark item that stands in it: edits, similarity and place of the best match."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def part(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = held.value
            for batch in batches:
                got = leaks(batch.column("text"), ix)
                at = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at),
                        pa.array([ix.ids[g[1]] for g in got], pa.int64()),
                        pa.array([g[2] for g in got], pa.int64()),
                        pa.array([1 - g[2] / len(ix.texts[g[1]]) for g in got], pa.float64()),
                        pa.array([g[3] for g in got], pa.int64()),
                        pa.array([g[4] for g in got], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "edits", "similarity", "start_byte", "end_byte"],
                )

        return rows.mapInArrow(B.lean(run), FOUND)

    parts, each = indexes(items, s)
    if parts == 1:
        return part(spark.sparkContext.broadcast(next(each)))
    folder = run_dir(spark, "leaks")
    for i, index in enumerate(each):
        held = spark.sparkContext.broadcast(index)
        part(held).write.parquet(f"{folder}/{i}")
        held.destroy()
    return spark.read.schema(FOUND).parquet(*[f"{folder}/{i}" for i in range(parts)])


def drop_leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, in which no benchmark item stands."""
    spark = docs.sparkSession
    place = docs.columns.index("text")

    def part(given: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[g[0] for g in leaks(batch.column(place), held.value)]] = False
                yield batch.filter(pa.array(clean))

        return given.mapInArrow(B.lean(run), given.schema)

    parts, each = indexes(items, s)
    if parts == 1:
        return part(docs, spark.sparkContext.broadcast(next(each)))
    folder = run_dir(spark, "clean")
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for i, index in enumerate(each):
        held = spark.sparkContext.broadcast(index)
        part(kept, held).write.parquet(f"{folder}/{i}")
        held.destroy()
        kept = spark.read.schema(kept.schema).parquet(f"{folder}/{i}")
        if i:
            remove_dir(spark, f"{folder}/{i - 1}")
    return kept.toDF(*docs.columns)


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
