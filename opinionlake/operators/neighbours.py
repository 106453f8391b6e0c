"""Exact nearest neighbours for a table of questions, by pivot partitions.

Corpus vectors are dealt to the cell of their nearest pivot. A question first
searches one part of its own cell; the distance of its k-th hit there is a
radius that no neighbour can lie beyond. It then goes only to the cells that
the triangle inequality can't rule out: those whose ring of distances to their
pivot, and whose side of the bisector to the question's own cell, come within
the radius. A cell with many rows is dealt into parts, and so are the questions,
so a task holds one block of each.

Questions and corpus stay in Spark. Only a bounded sample (for the pivots) and
one row per cell reach the driver. Questions travel packed, many in a row, and
after the first search only hits within a question's radius leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.profiles import NEIGHBOURS
from opinionlake.session import run_dir

BLOCK_BYTES = 8 << 20
DIGITS = 6
PIVOTS = 64
# Rows a cell should hold at least, where the corpus is small.
CELL_ROWS = 64
SAMPLE = 4096
# Questions whose costs are held at once.
ASKED = 512
# Pairs whose costs are confirmed at once.
PAIRS = 1 << 15
# Squared norms up to which single precision holds all products.
SINGLE_MOST = 1e30


@dataclass(frozen=True)
class Cells:
    """Pivots, and per cell with rows: pivot, least and largest distance, first group and number of parts. ``square``
    is the largest squared norm for products, where vectors get one more component to be equally long; else None."""

    pivots: np.ndarray
    square: float | None
    pivot: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return self.pivots.shape[1] - (self.square is not None)

    def placed(self, x: np.ndarray, asked: bool = False) -> np.ndarray:
        """Vectors as points in which near means a low cost."""
        if self.square is None:
            return x
        more = np.zeros(len(x)) if asked else np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))
        return np.column_stack([x, more])

    def far(self, points: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def cost(self, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances, or negative products, rounded so that the order of rows does not matter."""
        dot = asked @ rows.T
        if self.square is not None:
            return -dot.round(DIGITS)
        return np.maximum((asked**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1) - 2 * dot, 0).round(DIGITS)

    def pair_cost(self, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """``cost`` of one question and one row each."""
        dot = np.einsum("ij,ij->i", asked, rows)
        if self.square is not None:
            return -dot.round(DIGITS)
        return np.maximum((asked**2).sum(axis=1) + (rows**2).sum(axis=1) - 2 * dot, 0).round(DIGITS)

    def single(self, rows: np.ndarray) -> np.ndarray | None:
        """Rows in single precision for ``within``; None where their size does not allow it."""
        norm = (rows**2).sum(axis=1)
        if not norm.max() < SINGLE_MOST:
            return None
        half = np.zeros(len(rows)) if self.square is not None else norm / 2
        return np.column_stack([rows, -half, np.ones(len(rows))]).astype(np.float32).T

    def within(self, asked: np.ndarray, single: np.ndarray, longest: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(question, row) of all pairs whose cost may be within the question's ``least``, by question and row.

        One product in single precision, with all that its rounding can amount to on the safe side, so no pair within
        is left out. None where the size of the numbers does not allow it.
        """
        norm = (asked**2).sum(axis=1)
        room = least + 10.0**-DIGITS if self.square is not None else (least + 10.0**-DIGITS - norm) / 2
        if not (norm.max() < SINGLE_MOST and np.abs(room).max() < SINGLE_MOST):
            return None
        # Each of the dim + 2 terms of a product, and each sum of them, is off by a share of at most 2^-24; taken eight-fold.
        size = np.sqrt(norm) * longest + longest**2 + np.abs(room)
        room += (asked.shape[1] + 8) * 2.0**-21 * size + 2.0**-100
        line = np.column_stack([asked, np.ones(len(asked)), room]).astype(np.float32)
        return np.divmod(np.flatnonzero(line @ single >= 0), single.shape[1])

    def least_cost(self, asked: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The lowest cost a row of each cell can have for each question (``own``: the cell it was searched in first);
        with room for rounding."""
        points = self.placed(asked, asked=True)
        to = self.far(points)[:, self.pivot]
        gap = np.maximum(np.maximum(to - self.high, self.low - to), 0)
        here = self.pivots[self.pivot]
        between = np.sqrt(((here[:, None] - here[None]) ** 2).sum(axis=2))[own]
        home = np.take_along_axis(to, own[:, None], 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            side = np.where(between > 0, (to**2 - home**2) / (2 * between), 0)
        gap = np.maximum(np.maximum(gap, side) * (1 - 1e-9) - 1e-9, 0)
        square = gap**2
        if self.square is not None:
            square = (square - (asked**2).sum(axis=1)[:, None] - self.square) / 2
        return square - 2 * 10.0**-DIGITS - 1e-9 * np.abs(square)


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _whole(vec: Column, dim: int) -> Column:
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def _pivots(corpus: DataFrame, rows: int, square: float | None) -> np.ndarray:
    """Points of a bounded sample that lie apart: each the farthest from those before it, of a few drawn at random."""
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = corpus.where(draw <= min(1.0, SAMPLE / rows)).limit(2 * SAMPLE).select("vec").toArrow()
    x = _matrix((some if some.num_rows else corpus.limit(SAMPLE).select("vec").toArrow()).column("vec"))
    x = Cells(np.zeros((1, 1)), square).placed(x)
    rng = np.random.default_rng(len(x))
    chosen = [x[0]]
    for _ in range(min(PIVOTS, rows // CELL_ROWS) - 1):
        few = x[rng.integers(len(x), size=8)]
        gaps = ((few[:, None] - np.stack(chosen)[None]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(few[gaps.argmax()])
    return np.unique(np.stack(chosen), axis=0)


def _to_cells(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = cells.far(cells.placed(_matrix(batch.column("vec"))))
                cell = far.argmin(axis=1)
                more = [pa.array(cell, pa.int64()), pa.array(far[np.arange(len(far)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["doc_id", "vec", "cell", "dist"])

    return run


def _packs(batch_ids, x: np.ndarray, part: np.ndarray, own: np.ndarray, least: np.ndarray, group: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """Questions ``of[i]`` for ``group[i]``, packed by group and part."""
    x = _short(x)
    order = np.lexsort((of, part[of], group))
    group, of = group[order], of[order]
    edge = np.ones(len(of), bool)
    edge[1:] = (group[1:] != group[:-1]) | (part[of[1:]] != part[of[:-1]])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(of))
    cut = lambda a: pa.array([a[of[s:e]].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())
    ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)), pa.int32()), batch_ids.take(pa.array(of)))
    return pa.RecordBatch.from_arrays(
        [pa.array(group[starts], pa.int64()), pa.array(part[of[starts]], pa.int64()), ids, cut(x), cut(own), cut(least)],
        names=["group", "part", "ids", "x", "own", "least"],
    )


def _home(cells: Cells):
    """Questions to one part of the nearest cell that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                x = _matrix(some.column("vec"))
                own = cells.far(cells.placed(x, asked=True))[:, cells.pivot].argmin(axis=1)
                group = cells.first[own] + (at + np.arange(len(x))) % cells.parts[own]
                at += len(x)
                least = np.full(len(x), np.inf)
                yield _packs(some.column("query_id"), x, some.column("part").to_numpy(), own, least, group, np.arange(len(x)))

    return run


def _short(x: np.ndarray) -> np.ndarray:
    """Vectors in single precision, where that is what they were."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return single if (single == x).all() else x


def _unpacked(dim: int, x: bytes, own: bytes, least: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(own, np.int64)
    kind = np.float32 if len(x) == 4 * dim * len(own) else np.float64
    return np.frombuffer(x, kind).reshape(len(own), dim).astype(np.float64), own, np.frombuffer(least, np.float64)


def _beyond(cells: Cells):
    """Questions to all parts of the cells within their radius, but the part they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = np.repeat(np.arange(len(cells.parts)), cells.parts)
        for batch in batches:
            for i in range(batch.num_rows):
                x, own, least = _unpacked(cells.dim, *(batch.column(c)[i].as_py() for c in ("x", "own", "least")))
                near = cells.least_cost(x, own) <= least[:, None]
                of, group = np.nonzero(near[:, parts_of])
                other = group != batch.column("group")[i].as_py()
                if other.any():
                    part = np.full(len(x), batch.column("part")[i].as_py())
                    yield _packs(batch.column("ids")[i].values, x, part, own, least, group[other], of[other])

    return run


def _confirmed(cells: Cells, asked: np.ndarray, held: np.ndarray, q: np.ndarray, r: np.ndarray, least: np.ndarray):
    """The pairs that are within their question's ``least``, with their costs."""
    kept = []
    for at in range(0, len(q), PAIRS):
        some, row = q[at : at + PAIRS], r[at : at + PAIRS]
        cost = cells.pair_cost(asked[some], held[row])
        near = cost <= least[some]
        kept.append((some[near], row[near], cost[near]))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (q, r, np.zeros(0))


def _search(cells: Cells, k: int, first: bool):
    """Hits of one part of a cell; the first search also passes its questions on, with their radius."""

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        kind = asks.schema.field("ids").type
        kinds = {"query_id": kind.value_type, "doc_id": pa.int64(), "cost": pa.float64()}
        if first:
            kinds |= {"group": pa.int64(), "part": pa.int64(), "ids": kind, "x": pa.binary(), "own": pa.binary(), "least": pa.binary()}
        out = []

        def add(columns: dict, n: int) -> None:
            out.append(pa.table({c: columns.get(c, pa.nulls(n, t)) for c, t in kinds.items()}))

        if asks.num_rows:
            # However many packs they came in: a group and part hold one block of questions.
            ids = pa.concat_arrays([c.flatten() for c in asks.column("ids").chunks])
            packs = zip(*(asks.column(c).to_pylist() for c in ("x", "own", "least")), strict=True)
            x, own, least = (np.concatenate(v) for v in zip(*(_unpacked(cells.dim, *p) for p in packs), strict=True))
            held = _matrix(rows.column("vec")) if rows.num_rows else None
            doc = rows.column("doc_id").to_numpy()
            single = cells.single(held) if held is not None and not first else None
            longest = float(np.sqrt((held**2).sum(axis=1).max())) if single is not None else 0.0
            for lo in range(0, len(x) if held is not None else 0, ASKED):
                some, most = x[lo : lo + ASKED], least[lo : lo + ASKED]
                pairs = cells.within(some, single, longest, most) if single is not None else None
                if pairs is None:
                    cost = cells.cost(some, held)
                    if len(held) >= k:
                        most[:] = np.minimum(most, np.partition(cost, k - 1, axis=1)[:, k - 1])
                    q, r = np.nonzero(cost <= most[:, None])
                    c = cost[q, r]
                else:
                    q, r, c = _confirmed(cells, some, held, *pairs, most)
                order = np.lexsort((doc[r], c, q))
                order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
                hit = {"query_id": ids.take(pa.array(lo + q[order])), "doc_id": pa.array(doc[r[order]], pa.int64()), "cost": pa.array(c[order])}
                add(hit, len(order))
            if first:
                passed = {c: asks.column(c).slice(0, 1).combine_chunks() for c in ("group", "part")}
                packs = {c: pa.array([v.tobytes()], pa.binary()) for c, v in (("x", _short(x)), ("own", own), ("least", least))}
                add(passed | packs | {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(kind)}, 1)
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in kinds.items()})

    return run


def partitions(questions: DataFrame, corpus: DataFrame, dim: int, k: int, metric: str) -> tuple[DataFrame, DataFrame] | None:
    """(hits, visits): hits (query_id, doc_id, cost), the k nearest of each question among them, and the packed visits
    of parts of cells. None where there is no corpus."""
    spark = corpus.sparkSession
    folder = run_dir(spark, "neighbours")
    id_type = questions.schema["query_id"].dataType.simpleString()
    given = corpus.schema["vec"].dataType.simpleString()
    vec = given if given == "array<float>" else "array<double>"
    corpus = corpus.select("doc_id", F.col("vec").cast(vec).alias("vec")).where(_whole(F.col("vec"), dim))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    facts = corpus.agg(F.count("*").alias("n"), F.max(norm).alias("square")).first()
    if not facts["n"]:
        return None
    square = facts["square"] * (1 + 1e-9) if metric == "dot" else None
    cells = Cells(_pivots(corpus, facts["n"], square), square)
    keyed = f"doc_id long, vec {vec}, cell long, dist double"
    corpus.mapInArrow(_to_cells(cells), keyed).write.parquet(f"{folder}/cells")
    rows = spark.read.schema(keyed).parquet(f"{folder}/cells")
    most = max(k, BLOCK_BYTES // (8 * dim))
    found = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    found = found.orderBy("cell").collect()  # at most PIVOTS rows
    pivot, low, high, n = (np.array([r[c] for r in found]) for c in ("cell", "low", "high", "n"))
    parts = -(-n // most)
    cells = replace(cells, pivot=pivot, low=low, high=high, first=np.cumsum(parts) - parts, parts=parts)

    at = {r["cell"]: i for i, r in enumerate(found)}
    of_cell = lambda values: F.create_map(*[F.lit(x).cast("long") for c, i in at.items() for x in (c, int(values[i]))])[F.col("cell")]
    group = of_cell(cells.first) + F.pmod(F.xxhash64("doc_id"), of_cell(parts))
    placed = rows.select(group.alias("group"), "doc_id", "vec")
    asked = questions.select("query_id", F.col("vec").cast("array<double>").alias("vec")).where(_whole(F.col("vec"), dim))
    blocks = max(1, -(-asked.count() // most))
    asked = asked.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("part"))
    packed = f"group long, part long, ids array<{id_type}>, x binary, own binary, least binary"
    hits = f"query_id {id_type}, doc_id long, cost double"

    def searched(asks: DataFrame, name: str, first: bool) -> DataFrame:
        asks.write.parquet(f"{folder}/{name}-asks")
        asks, again = (spark.read.schema(packed).parquet(f"{folder}/{name}-asks") for _ in range(2))
        meeting = placed.join(again.select("group", "part").distinct(), "group").groupBy("group", "part")
        schema = f"{hits}, {packed}" if first else hits
        asks.groupBy("group", "part").cogroup(meeting).applyInArrow(_search(cells, k, first), schema).write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    near = searched(asked.mapInArrow(_home(cells), packed), "near", True)
    passed = near.where(F.col("ids").isNotNull()).select("group", "part", "ids", "x", "own", "least")
    far = searched(passed.mapInArrow(_beyond(cells), packed), "far", False)
    visits = [spark.read.schema(packed).parquet(f"{folder}/{name}-asks") for name in ("near", "far")]
    return near.where(F.col("doc_id").isNotNull()).select("query_id", "doc_id", "cost").unionByName(far), visits[0].unionByName(visits[1])


def nearest(questions: DataFrame, corpus: DataFrame, dim: int, k: int = NEIGHBOURS, metric: str = "l2") -> DataFrame:
    """(query_id, rank, doc_id, score): the k nearest, exactly.

    ``questions`` has query_id (any type), ``corpus`` has doc_id (64-bit), and
    both ``vec`` arrays; one that is null, of another length than ``dim`` or
    holds a null takes no part. Metric 'l2' is the squared distance, lower
    first; 'dot' the product, higher first, positive only. Ties go to the
    smaller id. Questions that share an id share one list.
    """
    found = partitions(questions, corpus, dim, k, metric)
    if found is None:
        id_type = questions.schema["query_id"].dataType.simpleString()
        return questions.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, doc_id long, score double")
    hits, _ = found
    if metric == "dot":
        hits = hits.where(F.col("cost") < 0)
    return ranked(hits.select("query_id", "doc_id", (F.col("cost") * (-1 if metric == "dot" else 1)).alias("score")), k, metric == "dot")


def touched(questions: DataFrame, corpus: DataFrame, dim: int, k: int = NEIGHBOURS, metric: str = "l2") -> DataFrame:
    """(query_id, parts): how many parts of cells each question was compared with."""
    _, visits = partitions(questions, corpus, dim, k, metric)
    return visits.select(F.explode("ids").alias("query_id")).groupBy("query_id").agg(F.count("*").alias("parts"))


def ranked(hits: DataFrame, k: int, falling: bool) -> DataFrame:
    best = F.col("score").desc() if falling else F.col("score")
    w = Window.partitionBy("query_id").orderBy(best, "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
