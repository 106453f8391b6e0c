"""Exact top-k search by inner product: a pivot-distance index.

Components become integers, so every score is exact. One more component, the
root of the largest squared norm minus a vector's own, makes all vectors
equally long; a query is scaled to that length, and a larger inner product then
is a smaller distance. Every vector is keyed by its nearest pivot and its
distance to it. By the triangle inequality a vector at distance r from a pivot
is at least |r - s| away from a query at distance s, so a ring of distances
(an annulus) around the pivot can be left out when even that distance gives
less than the query's k-th score so far.

1. Pivots are fitted on a bounded sample (``sample`` vectors, chosen by a hash
   of the id); all vectors are keyed and counted in ``bins`` rings per pivot.
2. Neighbouring rings form shells of about ``shell_bytes``; a ring larger than
   that is dealt into parts. The directory of shells holds at most ``pivots *
   bins`` entries, whatever the number of vectors.
3. A query first searches its home shell, the nearest one; the score of its
   (k + 1)-th hit there bounds its final k-th score from below.
4. It then goes to all other shells whose bound reaches that score, and to no
   more. Inside a shell rows are sorted by distance and taken annulus by
   annulus, the nearest first, until no query's bound reaches its score.
5. The hits of all shells are merged per query.

Queries travel packed, many of one shell in a row, and hits packed by bucket,
so no row is made per query and shell. Queries are dealt into parts of about
``shell_bytes`` too: a task holds one part of a shell and one part of the
queries that need it. Nothing of the data reaches the driver but the sample,
counts per ring and totals.

Equal vectors are one entry with their ``k + 1`` smallest ids (no more of them
can be among the first k) and one query. Whether rings can be left out depends
on the data: for vectors spread evenly in many dimensions all distances are
alike and nearly all shells are visited.

Cases: vectors that are null, empty, or hold a null, a non-finite number or one
that makes the squared integer norm too large for a long take no part, nor do
those of another length than the most frequent one (the shorter of equally
frequent ones); zero vectors do; a null id takes no part; of rows that share an
id the one with the smallest vector counts; ties go to the smaller id; with
fewer than k candidates all are returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionlake.llm.registry import ORACLES, query, table
from opinionlake.llm.vectors import matrix, same_length, takes_part
from opinionlake.session import run_dir

SCALE = 1024
NEVER = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    k: int = 10
    pivots: int = 32
    rounds: int = 4
    sample: int = 4096
    bins: int = 1024
    shell_bytes: int = 4 << 20
    annulus: int = 1024
    block: int = 256
    merge_rows: int = 20_000
    seed: int = 11


@dataclass(frozen=True)
class Index:
    """pivots (extended vectors), the squared length of all extended vectors, and the shells: pivot, least and largest
    distance, first group and number of parts of each; ``shell[pivot, bin]`` is the shell of a ring."""

    pivots: np.ndarray
    square: int
    width: float
    pivot: np.ndarray = None
    low: np.ndarray = None
    high: np.ndarray = None
    first: np.ndarray = None
    parts: np.ndarray = None
    shell: np.ndarray = None

    def extended(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt((self.square - (x * x).sum(axis=1)).astype(np.float64))])

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, distances to all pivots) of queries, after scaling."""
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        scaled = x * (np.sqrt(float(self.square)) / np.maximum(norm, 1e-300))[:, None]
        return norm, self.distances(np.column_stack([scaled, np.zeros(len(x))]))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From differences, so that small distances lose no digits."""
        out = np.empty((len(x), len(self.pivots)))
        for i, p in enumerate(self.pivots):
            out[:, i] = np.sqrt(((x - p) ** 2).sum(axis=1))
        return out

    def bounds(self, norm: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest score a vector in a ring can have, given the query's distance ``far`` to the ring's pivot; with
        room for rounding."""
        gap = np.maximum(np.maximum(low - far, far - high), 0)
        length = np.sqrt(float(self.square))
        gap = np.maximum(gap - 1e-9 * (2 * length + 1), 0)
        # The product of equally long vectors is length^2 - distance^2 / 2.
        best = (length - gap * (gap / (2 * max(length, 1e-300)))) * norm
        return np.floor(best + 1e-9 * (np.abs(best) + 1) + 1e-6).clip(-(2.0**62), 2.0**62)


def fit_pivots(sample: np.ndarray, square: int, s: Settings) -> Index:
    """Spread-out sample vectors, moved to the mean of the sample around them a few times."""
    start = Index(np.zeros((1, sample.shape[1] + 1)), square, 0.0)
    x = start.extended(sample)
    rng = np.random.default_rng(s.seed)
    chosen = np.unique(x[rng.permutation(len(x))[: s.pivots]], axis=0)
    for _ in range(s.rounds):
        near = Index(chosen, square, 0.0).distances(x).argmin(axis=1)
        chosen = np.stack([x[near == i].mean(axis=0) if (near == i).any() else p for i, p in enumerate(chosen)])
    width = max(2 * np.sqrt(float(square)), 1e-300) / s.bins
    return Index(chosen, square, width)


KEYED = "key long, ids array<long>, x array<long>, pivot int, bin int, dist double"


def _keyed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = index.distances(index.extended(matrix(batch.column("x"), np.int64)))
            pivot = far.argmin(axis=1)
            dist = far[np.arange(len(far)), pivot]
            ring = np.minimum((dist / index.width).astype(np.int64), int(2 * np.sqrt(float(index.square)) / index.width))
            more = [pa.array(pivot, pa.int32()), pa.array(ring, pa.int32()), pa.array(dist)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "ids", "x")), *more], names=["key", "ids", "x", "pivot", "bin", "dist"]
            )

    return run


def shells(index: Index, rings: list, most: int) -> Index:
    """The directory from (pivot, bin, n, low, high) per ring, sorted."""
    rows, shell = [], np.full((len(index.pivots), max((r["bin"] for r in rings), default=0) + 1), -1)
    for r in rings:
        last = rows[-1] if rows else None
        if last and last[0] == r["pivot"] and last[3] + r["n"] <= most:
            last[2], last[3] = r["high"], last[3] + r["n"]
        else:
            rows.append([r["pivot"], r["low"], r["high"], r["n"]])
        shell[r["pivot"], r["bin"]] = len(rows) - 1
    pivot, low, high, n = (np.array([x[i] for x in rows]) for i in range(4))
    parts = np.maximum(1, -(-n // most))
    return Index(index.pivots, index.square, index.width, pivot, low, high, np.cumsum(parts) - parts, parts, shell)


def _placed(index: Index):
    """Entries with the group that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shell = index.shell[batch.column("pivot").to_numpy(), batch.column("bin").to_numpy()]
            key = batch.column("key").to_numpy()
            spread = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            group = index.first[shell] + spread % index.parts[shell]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int64()), pa.array(shell, pa.int32()), *(batch.column(c) for c in ("key", "ids", "x", "dist"))],
                names=["group", "shell", "key", "ids", "x", "dist"],
            )

    return run


PLACED = "group long, shell int, key long, ids array<long>, x array<long>, dist double"
ASKS = "group long, part long, keys binary, x binary, least binary"


def _packed(columns: dict[str, tuple]) -> pa.RecordBatch:
    arrays = [pa.array(values, kind) for kind, values in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _asks(group: list, part: list, keys: np.ndarray, x: np.ndarray, least: np.ndarray, members: list) -> pa.RecordBatch:
    cut = lambda a: [a[m].tobytes() for m in members]
    return _packed({
        "group": (pa.int64(), group), "part": (pa.int64(), part),
        "keys": (pa.binary(), cut(keys)), "x": (pa.binary(), cut(x)), "least": (pa.binary(), cut(least)),
    })


def _by(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places where it stands."""
    order = np.argsort(values, kind="stable")
    if len(order):
        for m in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
            yield int(values[m[0]]), m


def _home(index: Index, parts: int):
    """Query vectors to one part of their nearest shell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                keys, x = some.column("key").to_numpy(), matrix(some.column("x"), np.int64)
                _, far = index.asked(x)
                far = far[:, index.pivot]
                gap = np.maximum(np.maximum(index.low - far, far - index.high), 0)
                # Of the shells it lies in or nearest to, the one with the nearest pivot.
                near = (gap + far * 1e-6).argmin(axis=1)
                group = index.first[near] + keys % index.parts[near]
                for g, m in _by(group):
                    for p, own in _by(keys[m] % parts):
                        yield _asks([g], [p], keys, x, np.full(len(keys), NEVER), [m[own]])

    return run


def _beyond(index: Index, parts: int):
    """Query vectors with the score to reach, to all parts of all shells that can reach it but the one seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys = np.frombuffer(batch.column("keys")[row].as_py(), np.int64)
                x = np.frombuffer(batch.column("x")[row].as_py(), np.int64).reshape(len(keys), -1)
                least = np.frombuffer(batch.column("least")[row].as_py(), np.int64)
                seen, part = batch.column("group")[row].as_py(), batch.column("part")[row].as_py()
                norm, far = index.asked(x)
                for shell, (low, high) in enumerate(zip(index.low, index.high, strict=True)):
                    reach = index.bounds(norm, far[:, index.pivot[shell]], low, high)
                    m = np.flatnonzero(reach >= least)
                    groups = [g for g in range(index.first[shell], index.first[shell] + index.parts[shell]) if g != seen]
                    if len(m) and groups:
                        yield _asks(groups, [part] * len(groups), keys, x, least, [m] * len(groups))

    return run


class Hits:
    """The best k + 1 (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.of, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray, least: np.ndarray) -> None:
        """Adds hits and raises ``least`` to the (k + 1)-th score where there is one."""
        of, score, ids = (np.concatenate([a, b]) for a, b in ((self.of, of), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place <= self.k
        self.of, self.score, self.id = of[keep], score[keep], ids[keep]
        full = np.flatnonzero(place[keep] == self.k)
        least[self.of[full]] = np.maximum(least[self.of[full]], self.score[full])


def _scores(x: np.ndarray, q: np.ndarray, square: int) -> np.ndarray:
    """Exact integer products, queries by rows: in double where no sum can pass 2^53, else in 64-bit integers."""
    if square < 1 << 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def scan(index: Index, rows: pa.Table, keys: np.ndarray, x: np.ndarray, least: np.ndarray, s: Settings) -> tuple[Hits, np.ndarray, int]:
    """(hits, the scores to reach afterwards, products) of queries in one part of a shell, annulus by annulus."""
    rows = rows.sort_by("dist").combine_chunks()
    held, dist = matrix(rows.column("x"), np.int64), rows.column("dist").to_numpy()
    lists = rows.column("ids").combine_chunks()
    first, count = lists.offsets.to_numpy()[:-1], lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()
    pivot = index.pivot[rows.column("shell")[0].as_py()]
    norm, far = index.asked(x)
    far = far[:, pivot]
    least = least.copy()
    found, products = Hits(len(keys), s.k), 0
    rings = [(lo, min(lo + s.annulus, len(dist))) for lo in range(0, len(dist), s.annulus)]
    order = np.argsort(far, kind="stable")
    for at in range(0, len(order), s.block):
        block = order[at : at + s.block]
        middle = float(np.median(far[block]))
        gap = lambda r: max(dist[r[0]] - middle, middle - dist[r[1] - 1], 0.0)
        best, need = Hits(len(block), s.k), least[block]
        for lo, hi in sorted(rings, key=gap):
            active = np.flatnonzero(index.bounds(norm[block], far[block], dist[lo], dist[hi - 1]) >= need)
            if not len(active):
                continue
            score = _scores(held[lo:hi], x[block[active]], index.square)
            products += score.size
            if hi - lo > s.k:
                need[active] = np.maximum(need[active], np.partition(score, hi - lo - s.k - 1, axis=1)[:, hi - lo - s.k - 1])
            q, r = np.nonzero(score >= need[active][:, None])
            each = np.repeat(np.arange(len(q)), count[lo + r])
            nth = np.arange(len(each)) - np.repeat(np.cumsum(count[lo + r]) - count[lo + r], count[lo + r])
            best.add(active[q[each]], score[q[each], r[each]], flat[first[lo + r[each]] + nth], need)
        found.of, found.score, found.id = (
            np.concatenate([a, b]) for a, b in ((found.of, block[best.of]), (found.score, best.score), (found.id, best.id))
        )
        least[block] = need
    return found, least, products


FOUND = "bucket long, keys binary, ids binary, scores binary"


def _asked(asks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, x, least = (np.frombuffer(b"".join(asks.column(c).to_pylist()), np.int64) for c in ("keys", "x", "least"))
    return keys, x.reshape(len(keys), -1), least


def _search(index: Index, buckets: int, s: Settings, first: bool):
    """Hits of one group, packed by bucket of the query. The first search also passes its queries on, in bucket -1."""
    kinds = {"bucket": pa.int64(), "keys": pa.binary(), "ids": pa.binary(), "scores": pa.binary()}
    if first:
        kinds |= {"group": pa.int64(), "part": pa.int64(), "x": pa.binary(), "least": pa.binary()}

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        if not asks.num_rows or not rows.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        keys, x, least = _asked(asks)
        hits, least, _ = scan(index, rows, keys, x, least, s)
        out = []
        for b, m in _by(keys[hits.of] % buckets):
            out.append({"bucket": b, "keys": keys[hits.of[m]].tobytes(), "ids": hits.id[m].tobytes(), "scores": hits.score[m].tobytes()})
        if first:
            passed = {"group": asks.column("group")[0].as_py(), "part": asks.column("part")[0].as_py()}
            out.append({"bucket": -1, "keys": keys.tobytes(), "x": x.tobytes(), "least": least.tobytes(), **passed})
        return pa.table({name: pa.array([r.get(name) for r in out], kind) for name, kind in kinds.items()})

    return run


def _merge(k: int):
    """The best k + 1 hits of each query of a bucket."""

    def run(found: pa.Table) -> pa.Table:
        keys, ids, scores = (np.frombuffer(b"".join(found.column(c).to_pylist()), np.int64) for c in ("keys", "ids", "scores"))
        order = np.lexsort((ids, -scores, keys))
        keys, ids, scores = keys[order], ids[order], scores[order]
        place = np.arange(len(keys)) - np.searchsorted(keys, keys)
        keep = np.flatnonzero(place <= k)
        names, starts = np.unique(keys[keep], return_index=True)
        offsets = pa.array(np.append(starts, len(keep)), pa.int32())
        hits = pa.StructArray.from_arrays([pa.array(ids[keep]), pa.array(scores[keep])], names=["vec_id", "score"])
        return pa.table({"key": pa.array(names, pa.int64()), "found": pa.ListArray.from_arrays(offsets, hits)})

    return run


def search(rows: DataFrame, is_query, vector: str = "embedding", key: str = "vec_id", s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` (a function of the id column) holds, its
    k best other rows."""
    spark = rows.sparkSession
    folder = run_dir(spark, "topk")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide = F.col(vector).cast("array<double>")
    norm = lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e)
    x = F.transform(wide, lambda e: F.floor(e * SCALE))
    fits = takes_part(wide, lambda e: F.abs(e * SCALE) < 2.0**31)
    good = rows.where(fits & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("x"))
    good = good.where(norm(F.col("x")) < 2.0**62).groupBy("id").agg(F.min("x").alias("x"))
    good.write.parquet(f"{folder}/rows")
    base = same_length(spark.read.schema("id long, x array<long>").parquet(f"{folder}/rows"), "x")
    if base is None:
        return empty

    nth = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    least_ids = base.withColumn("nth", nth).where(F.col("nth") <= s.k + 1).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    least_ids.select(F.col("ids")[0].alias("key"), "ids", "x").write.parquet(f"{folder}/entries")
    entries = spark.read.schema("key long, ids array<long>, x array<long>").parquet(f"{folder}/entries")
    square = F.aggregate("x", F.lit(0).cast("long"), lambda a, e: a + e * e)
    facts = entries.agg(F.count("*").alias("n"), F.max(square).alias("square"), F.max(F.size("x")).alias("dim")).first()
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = entries.where(draw < min(1.0, s.sample / facts["n"])).orderBy("key").limit(2 * s.sample).select("x").toArrow()
    if not sample.num_rows:
        sample = entries.orderBy("key").limit(s.sample).select("x").toArrow()
    index = fit_pivots(matrix(sample.column("x"), np.int64), facts["square"], s)
    entries.mapInArrow(_keyed(index), KEYED).write.parquet(f"{folder}/keyed")
    keyed = spark.read.schema(KEYED).parquet(f"{folder}/keyed")
    per_ring = keyed.groupBy("pivot", "bin").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    most = max(s.k + 1, s.shell_bytes // (8 * facts["dim"]))
    index = shells(index, per_ring.orderBy("pivot", "bin").collect(), most)  # at most pivots * bins rows
    placed = keyed.mapInArrow(_placed(index), PLACED)

    asked = base.where(is_query(F.col("id"))).join(entries.select("key", "x"), "x").select(F.col("id").alias("query_id"), "key")
    asked.write.parquet(f"{folder}/asked")
    asked = spark.read.schema("query_id long, key long").parquet(f"{folder}/asked")
    vectors = keyed.join(asked.select("key").distinct(), "key", "left_semi").select("key", "x")
    n = asked.count()
    parts, buckets = max(1, -(-n // most)), max(1, -(-n // s.merge_rows))

    def searched(asked_in: str, first: bool, to: str) -> DataFrame:
        """Only parts of shells that some query needs are sent to a task, once for each part of these queries."""
        asks, again = (spark.read.schema(ASKS).parquet(asked_in) for _ in range(2))
        needed = again.select("group", "part").distinct()
        meeting = asks.groupBy("group", "part").cogroup(placed.join(needed, "group").groupBy("group", "part"))
        more = ", group long, part long, x binary, least binary" if first else ""
        meeting.applyInArrow(_search(index, buckets, s, first), FOUND + more).write.parquet(to)
        return spark.read.schema(FOUND + more).parquet(to)

    vectors.mapInArrow(_home(index, parts), ASKS).write.parquet(f"{folder}/home")
    near = searched(f"{folder}/home", True, f"{folder}/near")
    passed = near.where(F.col("bucket") == -1).select("group", "part", "keys", "x", "least")
    passed.mapInArrow(_beyond(index, parts), ASKS).write.parquet(f"{folder}/beyond")
    far = searched(f"{folder}/beyond", False, f"{folder}/far")
    hits = near.where(F.col("bucket") >= 0).select("bucket", "keys", "ids", "scores").unionByName(far)
    merged = hits.groupBy("bucket").applyInArrow(_merge(s.k), "key long, found array<struct<vec_id:long,score:long>>")
    others = F.slice(F.filter("found", lambda h: h["vec_id"] != F.col("query_id")), 1, s.k)
    return (
        asked.join(merged, "key")
        .select("query_id", F.posexplode(others).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )


@query
def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


ORACLES["op11_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
