"""Hierarchical multi-length packing.

A document's ids (with the end id) give as many full windows of ``window``
tokens as fit, alone in their sequences. What is left is routed to the tier,
of several context sizes, that is the smallest to hold it. Each tier packs its
own pieces, longest first, into windows of its size; the gaps of longer windows
are filled with whole pieces from shorter tiers, and what remains of a gap with
the beginning of one more piece, so that every window is full and none needs
padding. Sequences of one tier go into step groups of equally many tokens.

A task packs the documents it reads, in lots of a bounded number of pieces;
nothing is shuffled, and sequence ids hold the task's number. Only the last
sequence of a task may be padded (fewer tokens than the shortest tier are left).

Cases: a null or empty text is the end id alone; rows that share an id are
packed each on its own, so their pieces carry the same id; with no rows there is
no sequence. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake.llm import bytesio as B
from opinionlake.llm import tokens as K
from opinionlake.llm.registry import query, table


@dataclass(frozen=True)
class Settings:
    tiers: tuple[int, ...] = (128, 256, 512, 1024)
    lot: int = 20_000
    step_tokens: int = 8192


PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)


@dataclass
class Piece:
    """Ids of a document from ``start`` on."""

    doc: int | None
    start: int
    ids: np.ndarray = field(repr=False)
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.doc_tokens), Piece(
            self.doc, self.start + n, self.ids[n:], self.doc_tokens
        )


class Packer:
    """Packs the pieces of one task; ``take`` hands over the finished rows."""

    def __init__(self, task: int, s: Settings) -> None:
        self.s, self.task = s, task
        self.waiting: dict[int, list[Piece]] = {t: [] for t in s.tiers}
        self.sequences = 0
        self.in_tier = dict.fromkeys(s.tiers, 0)
        self.rows: list[tuple] = []

    def _emit(self, tier: int, pieces: list[Piece]) -> None:
        per_step = max(1, self.s.step_tokens // tier)
        step = (self.task << 33) + (self.in_tier[tier] // per_step) * len(self.s.tiers) + self.s.tiers.index(tier)
        self.in_tier[tier] += 1
        number = (self.task << 33) + self.sequences
        self.sequences += 1
        offset = 0
        for p in pieces:
            self.rows.append((p.doc, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, number, offset, tier, step))
            offset += len(p.ids)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        top = self.s.tiers[-1]
        whole = len(ids) // top * top
        for at in range(0, whole, top):
            self._emit(top, [Piece(doc, at, ids[at : at + top], len(ids))])
        rest = len(ids) - whole
        if rest:
            tier = next(t for t in self.s.tiers if t >= rest)
            self.waiting[tier].append(Piece(doc, whole, ids[whole:], len(ids)))
        if sum(map(len, self.waiting.values())) >= self.s.lot:
            self.pack()

    def _route(self, piece: Piece) -> None:
        if len(piece.ids):
            self.waiting[next(t for t in self.s.tiers if t >= len(piece.ids))].append(piece)

    def _fill(self, gap: int, sorted_waiting: dict[int, list]) -> list[Piece]:
        """Whole pieces, longest first, that fit the gap, from the tiers that may fit."""
        out = []
        for tier in reversed(self.s.tiers):
            held = sorted_waiting[tier]
            while held and gap:
                # The longest piece of the tier that still fits.
                lo, hi = 0, len(held)
                while lo < hi:
                    mid = (lo + hi) // 2
                    if len(held[mid].ids) <= gap:
                        lo = mid + 1
                    else:
                        hi = mid
                if not lo:
                    break
                out.append(held.pop(lo - 1))
                gap -= len(out[-1].ids)
        return out

    def pack(self, last: bool = False) -> None:
        """Packs what waits, tier by tier from the longest; pieces that fill no window wait on unless ``last``."""
        held = {t: sorted(p, key=lambda x: len(x.ids)) for t, p in self.waiting.items()}
        self.waiting = {t: [] for t in self.s.tiers}
        for tier in reversed(self.s.tiers):
            while held[tier]:
                left = sum(len(p.ids) for t in self.s.tiers for p in held[t][-(2 * tier) :])
                if left < tier:
                    break
                window = [held[tier].pop()]
                gap = tier - len(window[0].ids)
                window += self._fill(gap, held)
                gap = tier - sum(len(p.ids) for p in window)
                if gap:
                    # The beginning of one more piece closes the gap; every piece left is longer than the gap.
                    source = next(t for t in self.s.tiers if held[t])
                    head, tail = held[source].pop(0).cut(gap)
                    window.append(head)
                    again = next(t for t in self.s.tiers if t >= len(tail.ids))
                    at = np.searchsorted([len(p.ids) for p in held[again]], len(tail.ids)) if len(held[again]) < 64 else 0
                    held[again].insert(int(at), tail)
                self._emit(tier, window)
        for pieces in held.values():
            for p in pieces:
                self._route(p)
        if last:
            self._finish()

    def _finish(self) -> None:
        """The few tokens left: windows of falling sizes, each full, and at most one that is padded."""
        rest = [p for t in reversed(self.s.tiers) for p in self.waiting[t]]
        self.waiting = {t: [] for t in self.s.tiers}
        total = sum(len(p.ids) for p in rest)
        for tier in [*reversed(self.s.tiers), 0]:
            while total and (total >= tier or not tier):
                want = tier or total
                window = []
                while want:
                    p = rest.pop(0)
                    if len(p.ids) > want:
                        p, tail = p.cut(want)
                        rest.insert(0, tail)
                    window.append(p)
                    want -= len(p.ids)
                    total -= len(p.ids)
                self._emit(tier or self.s.tiers[-1], window)

    def take(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        cols = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(names)
        self.rows = []
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)


def pack(docs: DataFrame, path: str | None = None, s: Settings = Settings(), forget: bool = False) -> DataFrame:
    """One row per piece: its ids (little-endian 32-bit), its document and where it stands in which sequence.

    With ``forget`` a task leaves no encoded chunks behind in its worker, for jobs that go on to other work there.
    """
    path = path or K.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), s)
        encoder = K.encoder(path)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for rows, ids, per in encoder.column(batch.column("text")):
                at = 0
                for row, n in zip(rows.tolist(), per.tolist(), strict=True):
                    packer.add(keys[row], np.append(ids[at : at + n], np.uint32(K.END)))
                    at += n
                if len(packer.rows) >= 20_000:
                    yield packer.take()
        packer.pack(last=True)
        yield packer.take()
        if forget:
            K.encoder.cache_clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(B.lean(run), PIECES)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
