"""Approximate nearest neighbours: a forest of random-projection trees.

Each tree splits space by random directions at the median of a bounded sample
of vectors. A query walks all trees with one shared priority queue, nearest
cell first, until the leaves it has visited hold a certain share of the sample.
Every row of those leaves is a candidate and is ranked by its exact inner
product in double precision. The share is fitted on the sample too: ``tries``
of its vectors search it, and the share is the one after which ``recall`` of
their true neighbours (as many as stand for k of all rows) had been reached.

Vectors of any length are searched for the largest inner product: one more
component, the root of the largest squared norm minus a vector's own, makes all
equally long, so that nearness in angle follows the inner product.

What is broadcast is the forest (fixed by the settings). All rows are indexed:
each is sent to its leaf of every tree, each query to the leaves it visits; a
leaf's candidates are scored by one matrix product and only its best ``k + 1``
per query leave the task. Rows and visits are counted per leaf first. A leaf
that holds more than ``leaf_rows`` rows, or rows or visits of more than
``group_bytes``, is dealt into parts on that side, and every part of its visits
meets every part of its rows; ``block`` queries are scored at once.

Equal vectors are one entry of the index with their ``k + 1`` smallest ids (no
more of them can be among the first k), and one query, so that copies cannot
fill a leaf; the result is expanded to all queries.

Cases: vectors that are null, empty, zero or hold a null or a non-finite number
take no part, nor do those of another length than the most frequent one (the
shorter of equally frequent ones); a null id takes no part; of rows that share
an id the one with the smallest vector counts; ties go to the smaller id; with
fewer than k candidates all are returned. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionlake.llm.registry import query, table
from opinionlake.session import run_dir


@dataclass(frozen=True)
class Settings:
    k: int = 20
    trees: int = 8
    depth: int = 8
    leaf_sample: int = 12
    sample: int = 4096
    tries: int = 128
    recall: float = 0.95
    leaf_rows: int = 20_000
    group_bytes: int = 16 << 20
    block: int = 256
    seed: int = 5


@dataclass
class Forest:
    """directions[t, node], cuts[t, node]: inner nodes level by level; held[t, leaf]: which sample rows are there."""

    depth: int
    directions: np.ndarray = field(repr=False)
    cuts: np.ndarray = field(repr=False)
    held: np.ndarray = field(repr=False)
    longest: float
    share: float = 1.0

    def extended(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, more])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x = self.extended(x)
        out = np.empty((len(x), len(self.cuts)), np.int64)
        for t, (directions, cuts) in enumerate(zip(self.directions, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            side = x @ directions.T > cuts
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(x)), node]
            out[:, t] = node - (2**self.depth - 1)
        return out

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue."""
        q = np.append(q / max(np.linalg.norm(q), 1e-300) * self.longest, 0.0)
        margin = self.directions @ q - self.cuts
        queue = [(-np.inf, t, 0) for t in range(len(self.cuts))]
        inner = 2**self.depth - 1
        while queue:
            far, t, node = heapq.heappop(queue)
            if node >= inner:
                yield t, node - inner
                continue
            # The distance of a cell is the largest by which a cut on the way was crossed.
            heapq.heappush(queue, (max(far, margin[t, node]), t, 2 * node + 1))
            heapq.heappush(queue, (max(far, -margin[t, node]), t, 2 * node + 2))

    def visit(self, q: np.ndarray) -> list[tuple[int, int]]:
        """The leaves a query visits."""
        seen, out = np.zeros(self.held.shape[2], bool), []
        for t, leaf in self.walk(q):
            if seen.sum() >= self.share * len(seen) and out:
                break
            out.append((t, leaf))
            seen |= self.held[t, leaf]
        return out


def fit(sample: np.ndarray, longest: float, total: int, s: Settings) -> Forest:
    """A forest for ``total`` vectors of which ``sample`` is a part."""
    rng = np.random.default_rng(s.seed)
    depth = max(1, min(s.depth, int(np.log2(max(2, len(sample) / s.leaf_sample)))))
    nodes = 2**depth - 1
    directions = rng.normal(size=(s.trees, nodes, sample.shape[1] + 1))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    forest = Forest(depth, directions, np.zeros((s.trees, nodes)), np.zeros((s.trees, nodes + 1, len(sample)), bool), longest)
    x = forest.extended(sample)
    for t in range(s.trees):
        groups = {0: np.arange(len(sample))}
        for node in range(nodes):
            rows = groups.pop(node)
            side = x[rows] @ directions[t, node]
            forest.cuts[t, node] = np.median(side) if len(side) else 0.0
            right = side > forest.cuts[t, node]
            groups[2 * node + 1], groups[2 * node + 2] = rows[~right], rows[right]
        for leaf, rows in groups.items():
            forest.held[t, leaf - nodes, rows] = True
    forest.share = _share(forest, sample, total, s)
    return forest


def _share(forest: Forest, sample: np.ndarray, total: int, s: Settings) -> float:
    """The share of the sample after which the wanted part of true neighbours has been reached."""
    near = max(1, round(s.k * len(sample) / total))
    if len(sample) <= near + 1:
        return 1.0
    reached = []
    for i in np.unique(np.linspace(0, len(sample) - 1, s.tries).astype(int)):
        score = sample @ sample[i]
        score[i] = -np.inf
        left = np.zeros(len(sample), bool)
        left[np.argpartition(-score, near)[:near]] = True
        seen = np.zeros(len(sample), bool)
        for t, leaf in forest.walk(sample[i]):
            seen |= forest.held[t, leaf]
            found = left & seen
            if found.any():
                reached += [seen.mean()] * int(found.sum())
                left &= ~found
                if not left.any():
                    break
    return float(np.quantile(reached, s.recall))


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def usable(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v): one row per id with a vector that takes part."""
    v = F.col(vector).cast("array<double>")
    fine = (
        v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    good = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)) & F.col(key).isNotNull())
    return good.groupBy("id").agg(F.min("v").alias("v"))


ENTRY = "leaf long, key long, ids array<long>, v array<double>"
VISITS = "key long, v array<double>, leaves array<int>"
# Rows of a batch of visits.
ROWS = 1 << 14


@dataclass
class Deal:
    """For each leaf of all trees: in how many parts its visits and its rows are, and the number of its first group."""

    visits: np.ndarray
    rows: np.ndarray
    first: np.ndarray

    def group(self, leaf: np.ndarray, visit_part: np.ndarray, row_part: np.ndarray) -> np.ndarray:
        return self.first[leaf] + visit_part * self.rows[leaf] + row_part


def deal(visits: np.ndarray, rows: np.ndarray, most_visits: int, most_rows: int) -> Deal:
    """From the number of visits and rows of each leaf."""
    a, b = (np.maximum(1, -(-n // most)) for n, most in ((visits, most_visits), (rows, most_rows)))
    return Deal(a, b, np.cumsum(a * b) - a * b)


def _part(key: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of each key, of ``parts`` many."""
    mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return mixed.astype(np.int64) % parts


def _all_leaves(f: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree, numbered through all trees."""
    return f.leaves(x) + (np.arange(len(f.cuts)) << f.depth)


def _counts(given: DataFrame, leaves_of, n: int) -> np.ndarray:
    """How many rows of ``given`` come to each of n leaves; ``leaves_of`` takes a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(leaves_of(batch), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["leaf", "n"])

    found = np.zeros(n, np.int64)
    for r in given.mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        found[r["leaf"]] = r["n"]
    return found


def _to_leaves(forest, dealt: Deal):
    """Entries of the index, at their leaf of every tree, once for each part of its visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = _all_leaves(forest.value, _matrix(batch.column("v")))
            key = batch.column("key").to_numpy()
            for leaf in leaves.T:
                part = _part(key, dealt.rows[leaf])
                for visit_part in range(int(dealt.visits[leaf].max(initial=0))):
                    some = np.flatnonzero(dealt.visits[leaf] > visit_part)
                    at = dealt.group(leaf[some], visit_part, part[some])
                    take = pa.array(some, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at, pa.int64()), *(batch.column(c).take(take) for c in ("key", "ids", "v"))],
                        names=["leaf", "key", "ids", "v"],
                    )

    return run


def _walks(forest):
    """Queries with the leaves they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            x = _matrix(batch.column("v"))
            for lo in range(0, len(x), 256):
                some = batch.slice(lo, 256)
                leaves = [[(t << f.depth) + leaf for t, leaf in f.visit(q)] for q in x[lo : lo + 256]]
                yield pa.RecordBatch.from_arrays(
                    [some.column("key"), some.column("v"), pa.array(leaves, pa.list_(pa.int32()))], names=["key", "v", "leaves"]
                )

    return run


def _to_visits(dealt: Deal):
    """Queries, at every leaf they visit, once for each part of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            leaves = batch.column("leaves")
            sizes = leaves.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            flat = leaves.flatten().to_numpy()
            of = np.repeat(np.arange(len(key)), sizes)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
                leaf, row = flat[lo : lo + ROWS], of[lo : lo + ROWS]
                part = _part(key[row], dealt.visits[leaf])
                for row_part in range(int(dealt.rows[leaf].max())):
                    some = np.flatnonzero(dealt.rows[leaf] > row_part)
                    at = dealt.group(leaf[some], part[some], row_part)
                    take = pa.array(row[some], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at, pa.int64()), batch.column("key").take(take), batch.column("v").take(take)],
                        names=["leaf", "key", "v"],
                    )

    return run


BEST = "key long, ids binary, scores binary"


def _score(k: int, block: int = Settings.block):
    """The best k + 1 rows of one group for each query that visits it, ``block`` queries at once."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"key": [], "ids": [], "scores": []}
        if queries.num_rows and rows.num_rows:
            asked, held = _matrix(queries.column("v")), _matrix(rows.column("v")).T
            keys = rows.column("key").to_numpy()
            ids = rows.column("ids").to_pylist()
            names = queries.column("key").to_pylist()
            for i, name in enumerate(names):
                if i % block == 0:
                    scores = asked[i : i + block] @ held
                line = scores[i % block]
                if len(line) > k + 1:
                    least = np.partition(line, len(line) - k - 1)[len(line) - k - 1]
                    some = np.flatnonzero(line >= least)
                else:
                    some = np.arange(len(line))
                some = some[np.lexsort((keys[some], -line[some]))][: k + 1]
                best = sorted((-line[j], x) for j in some.tolist() for x in ids[j])[: k + 1]
                out["key"].append(name)
                out["ids"].append(np.array([x for _, x in best], "<i8").tobytes())
                out["scores"].append(np.array([-x for x, _ in best], "<f8").tobytes())
        return pa.table({"key": pa.array(out["key"], pa.int64()), "ids": pa.array(out["ids"], pa.binary()), "scores": pa.array(out["scores"], pa.binary())})

    return run


def _merge(k: int):
    """The best k + 1 rows of one query over its leaves; a row found in several trees counts once."""

    def run(found: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(found.column("ids").to_pylist()), "<i8")
        scores = np.frombuffer(b"".join(found.column("scores").to_pylist()), "<f8")
        _, first = np.unique(ids, return_index=True)
        order = first[np.lexsort((ids[first], -scores[first]))][: k + 1]
        return pa.table(
            {
                "key": pa.array([found.column("key")[0].as_py()], pa.int64()),
                "found": pa.array([[{"vec_id": int(ids[i]), "score": float(scores[i])} for i in order]], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))),
            }
        )

    return run


def search(rows: DataFrame, is_query, vector: str = "embedding", key: str = "vec_id", s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` (a function of the id column) holds, its
    nearest other rows."""
    spark = rows.sparkSession
    folder = run_dir(spark, "vectors")
    usable(rows, vector, key).write.parquet(f"{folder}/rows")
    base = spark.read.parquet(f"{folder}/rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = base.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if sizes is None:
        return empty
    base = base.where(F.size("v") == sizes["n"])
    # The k + 1 smallest ids of each distinct vector; the limit works before the shuffle too.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = F.sort_array(F.collect_list("id"))
    base.withColumn("nth", nth).where(F.col("nth") <= s.k + 1).groupBy("v").agg(ids.alias("ids")).select(
        F.col("ids")[0].alias("key"), "ids", "v"
    ).write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = entries.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = entries.where(draw < min(1.0, s.sample / facts["n"])).orderBy("key").select("v").toArrow()
    if not sample.num_rows:
        sample = entries.orderBy("key").limit(s.sample).select("v").toArrow()
    # Rounding up keeps every vector inside the sphere.
    forest = fit(_matrix(sample.column("v")), float(facts["longest"]) * (1 + 1e-9), facts["n"], s)
    held = spark.sparkContext.broadcast(forest)

    asked = base.where(is_query(F.col("id"))).join(entries.select("key", "v"), "v").select(F.col("id").alias("query_id"), "key")
    vectors = entries.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v")
    vectors.mapInArrow(_walks(held), VISITS).write.parquet(f"{folder}/visits")
    walked = spark.read.schema(VISITS).parquet(f"{folder}/visits")
    leaves = s.trees << forest.depth
    visited = _counts(walked.select("leaves"), lambda b: b.column("leaves").flatten().to_numpy(), leaves)
    filled = _counts(entries.select("v"), lambda b: _all_leaves(held.value, _matrix(b.column("v"))).ravel(), leaves)
    most = max(1, s.group_bytes // (8 * sizes["n"]))
    dealt = deal(visited, filled, most, min(most, s.leaf_rows))
    visits = walked.mapInArrow(_to_visits(dealt), "leaf long, key long, v array<double>")
    placed = entries.mapInArrow(_to_leaves(held, dealt), ENTRY)
    best = visits.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInArrow(_score(s.k, s.block), BEST)
    merged = best.groupBy("key").applyInArrow(_merge(s.k), "key long, found array<struct<vec_id:long,score:double>>")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, s.k)
    return (
        asked.join(merged, "key")
        .select("query_id", F.posexplode(others).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
