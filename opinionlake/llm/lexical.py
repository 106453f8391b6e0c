"""Ranked lexical search: terms owned by successive stages, documents by groups.

Items are searched in bundles. A bundle meets every group of documents, and
carries for it a sparse accumulator: the partial score of each of its items in
each document that can still be among the k best. It passes the owners of the
terms one after the other; an owner holds the postings of its terms and adds
their integer contributions in a cogroup of (bundle, group). Owners hold bands
of terms by document frequency, rare terms first, so that few documents are
carried.

After each stage the k-th best partial score of an item over all groups bounds
its final k-th score from below, since no contribution is negative. A document
whose partial score and the most that later owners can add stay below this
bound is no longer carried; nothing that can be among the k best is lost.

1. Documents are read once. A task makes a shard of consecutive documents: the
   postings (term, document, frequency) of words that may be terms of an item,
   and the number of terms per document. A bitmap of ``SLOTS`` bits says which
   words may be; words that share a slot with a term are carried along, and
   left out at the join with the items' terms.
2. Document frequencies and totals are added up; bands are chosen per slot, in
   an array of fixed size.
3. Shards are split by band and dealt into groups of about ``group_bytes`` of
   postings, so that a term that all documents hold is spread over all groups.
4. The stages, then the final selection with document ids, and a window.

Words are told apart by a 64-bit hash. The bitmap and the bands (one bit and
one byte a slot) are all that is broadcast, whatever the number of items and
documents; bundles meet groups by replicating rows of packed arrays.

Cases: a null or empty text has no terms and is no document; an item without
terms, or whose terms no document holds, has no rows; rows that share a doc_id
are documents of their own, rows that share an item_id items of their own (each
with its ranks); null ids are carried along, a null doc_id comes last among
equal scores, then rows in the order they were read; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionlake.llm import bytesio as B
from opinionlake.llm.registry import ORACLES, query, table
from opinionlake.session import run_dir

SEPARATOR = B.byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
SLOTS = 1 << 20
# What one term can add, per unit of its weight: (1000000000 tf) div (1000 tf + 8 m) stays below it.
MOST = 1_000_000


@dataclass(frozen=True)
class Settings:
    k: int = 10
    owners: int = 4
    # A shard of documents, the postings of a group, the items of a bundle.
    shard_bytes: int = 8 << 20
    group_bytes: int = 8 << 20
    bundle: int = 256


def _at_separator(data: np.ndarray) -> np.ndarray:
    return SEPARATOR[data]


def terms(col) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term of a column of texts, A-Z in lower case."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for block in B.blocks(col, _at_separator):
        held = block._replace(data=B.LOWER[block.data])
        starts, ends, segment = B.word_bounds(held, SEPARATOR)
        hashes.append(B.range_hash(B.prefix_sums(held.data), starts, ends))
        rows.append(block.rows[segment])
    return np.concatenate(hashes), np.concatenate(rows)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes of text, at least one row each."""
    _, at = B.column_bytes(batch.column("text"))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(at, at[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows, lo + (1 << 20))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _numbered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces with a number that no other piece of any task has."""
    number = TaskContext.get().partitionId() << 20
    for batch in batches:
        for piece in _pieces(batch, most):
            yield number, piece
            number += 1


def _row(columns: dict) -> pa.RecordBatch:
    kind = lambda v: pa.binary() if isinstance(v, bytes) else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array([v], kind(v)) for v in columns.values()], names=list(columns))


SHARD = "shard long, documents long, words long, ids binary, known binary, terms binary, counts binary, docs binary, tfs binary, sizes binary"


def _shards(bitmap, most: int):
    """One row per shard. ``ids``, ``known`` (whether not null) per document; ``counts`` postings for each of
    ``terms``, and for each posting document, frequency and the document's number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bitmap.value).astype(bool)
        for shard, piece in _numbered(batches, most):
            hashes, rows = terms(piece.column("text"))
            sizes = np.bincount(rows, minlength=piece.num_rows)
            may = np.flatnonzero(wanted[_slot(hashes)])
            order = may[np.lexsort((rows[may], hashes[may]))]
            h, r = hashes[order], rows[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            tfs = np.diff(np.append(at, len(h)))
            h, r = h[at], r[at]
            names, counts = np.unique(h, return_counts=True)
            ids = piece.column("doc_id").cast(pa.int64())
            yield _row({
                "shard": shard, "documents": int((sizes > 0).sum()), "words": len(hashes),
                "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "known": ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                "terms": names.tobytes(), "counts": counts.astype("<u4").tobytes(), "docs": r.astype("<u4").tobytes(),
                "tfs": tfs.astype("<u4").tobytes(), "sizes": sizes[r].astype("<u4").tobytes(),
            })

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
            held = [np.frombuffer(names.as_py(), np.int64), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], names=["term", "df"])


BANDED = "band int, shard long, terms binary, counts binary, docs binary, tfs binary, sizes binary"


def _banded(bands, owners: int):
    """A shard's postings by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], "<u4")
                each = [np.frombuffer(row[c], "<u4") for c in ("docs", "tfs", "sizes")]
                band = bands.value[_slot(names)]
                of = np.repeat(band, counts)
                for b in range(owners):
                    if (band == b).any():
                        held = {"terms": names[band == b].tobytes(), "counts": counts[band == b].tobytes()}
                        held |= {c: x[of == b].tobytes() for c, x in zip(("docs", "tfs", "sizes"), each, strict=True)}
                        row_b = _row({"shard": row["shard"], **held})
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *row_b.columns], names=["band", *row_b.schema.names])

    return run


ITEM_TERMS = "bundle long, item int, term long"


def _items(most: int):
    """Items as (bundle, item): numbered within bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId() << 20, 0
        for batch in batches:
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            columns = [pa.array(number + place // most, pa.int64()), pa.array(place % most, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=["bundle", "item", *batch.schema.names])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch, 1 << 20):
            hashes, rows = terms(piece.column("text"))
            both = np.unique(np.stack([rows, hashes.view(np.int64)]), axis=1)
            take = pa.array(both[0])
            yield pa.RecordBatch.from_arrays(
                [piece.column("bundle").take(take), piece.column("item").take(take), pa.array(both[1])], names=["bundle", "item", "term"]
            )


def _numbers(table_: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table_.column(column).to_pylist() if x), kind)


CARRIED = "b long, g long, bundle long, items binary, docs binary, scores binary, tops binary"


@dataclass(frozen=True)
class Totals:
    documents: int
    words: int

    def contribution(self, weight: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * size * self.documents) // self.words
        return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Postings:
    """Postings of one owner in one group, sorted by term."""

    def __init__(self, rows: pa.Table, weights: dict[int, int], totals: Totals) -> None:
        counts = _numbers(rows, "counts", "<u4")
        names = np.repeat(_numbers(rows, "terms", np.int64), counts)
        per_row = [len(x) // 4 for x in rows.column("docs").to_pylist()]
        doc = (np.repeat(rows.column("shard").to_numpy(), per_row) << 20) | _numbers(rows, "docs", "<u4").astype(np.int64)
        tf, size = (_numbers(rows, c, "<u4").astype(np.int64) for c in ("tfs", "sizes"))
        known = np.array(sorted(weights), np.int64)
        at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
        mine = np.flatnonzero(known[at] == names) if len(known) else np.zeros(0, np.int64)
        mine = mine[np.argsort(names[mine], kind="stable")]
        weight = np.array([weights[int(t)] for t in known], np.int64)[at[mine]] if len(known) else np.zeros(0, np.int64)
        self.names, self.docs = names[mine], doc[mine]
        self.adds = totals.contribution(weight, tf[mine], size[mine])

    def of(self, term: int) -> slice:
        return slice(*(int(np.searchsorted(self.names, term, side=side)) for side in ("left", "right")))


def _stage(totals: Totals, k: int):
    """One owner's contributions to the accumulators of one bundle and group."""

    def run(left: pa.Table, rows: pa.Table) -> pa.Table:
        plans = [r for r in left.select(["bundle", "plan"]).to_pylist() if r["plan"] is not None]
        held = left.filter(left.column("docs").is_valid())
        weights = {t["term"]: t["weight"] for p in plans for i in p["plan"] for t in i["terms"]}
        postings = Postings(rows, weights, totals)
        carried: dict[int, tuple] = {}
        for row in held.select(["bundle", "items", "docs", "scores"]).to_pylist():
            items = np.frombuffer(row["items"], "<i4")
            docs, scores = (np.frombuffer(row[c], "<i8") for c in ("docs", "scores"))
            for some in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1):
                if len(some):
                    carried[row["bundle"], int(items[some[0]])] = (docs[some], scores[some])
        before = [d for d, _ in carried.values()]
        names, place = np.unique(np.concatenate([postings.docs, *before]), return_inverse=True)
        place = place[: len(postings.docs)]
        out = {name: [] for name in ("b", "g", "bundle", "items", "docs", "scores", "tops")}
        for p in plans:
            kept, best = [], []
            for i in p["plan"]:
                total = np.zeros(len(names), np.int64)
                docs, scores = carried.get((p["bundle"], i["item"]), (None, None))
                if docs is not None:
                    total[np.searchsorted(names, docs)] = scores
                for t in i["terms"]:
                    some = postings.of(t["term"])
                    total[place[some]] += postings.adds[some]  # a document stands once in a term's postings
                at = np.flatnonzero(total)
                if not len(at):
                    continue
                score = total[at]
                least = i["least"]
                if len(at) >= k:
                    top = np.partition(score, len(at) - k)[len(at) - k :]
                    least = max(least, int(top.min()))
                else:
                    top = score
                best.append((i["item"], top))
                fine = score + i["rest"] >= least
                kept.append((i["item"], names[at[fine]], score[fine]))
            for c, v in (("b", left.column("b")[0].as_py()), ("g", left.column("g")[0].as_py()), ("bundle", p["bundle"])):
                out[c].append(v)
            join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind).tobytes()
            out["items"].append(join([np.full(len(d), i) for i, d, _ in kept], "<i4"))
            out["docs"].append(join([d for _, d, _ in kept], "<i8"))
            out["scores"].append(join([s for _, _, s in kept], "<i8"))
            out["tops"].append(join([np.stack([np.full(len(t), i), t], axis=1).ravel() for i, t in best], "<i8"))
        kinds = dict.fromkeys(("b", "g", "bundle"), pa.int64()) | dict.fromkeys(("items", "docs", "scores", "tops"), pa.binary())
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})

    return run


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle, tops in zip(batch.column("bundle").to_pylist(), batch.column("tops").to_pylist(), strict=True):
            t = np.frombuffer(tops, "<i8").reshape(-1, 2)
            columns = [pa.array(np.full(len(t), bundle)), pa.array(t[:, 0], pa.int32()), pa.array(t[:, 1], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["bundle", "item", "score"])


SELECTED = "bundle long, item int, row long, doc_id long, score long"


def _select(k: int):
    """The k best documents of a group for each item, with their ids."""

    def run(held: pa.Table, shards: pa.Table) -> pa.Table:
        kinds = {"bundle": pa.int64(), "item": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
        ids = {r["shard"]: (np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["known"], np.uint8)) for r in shards.to_pylist()}
        out = []
        for row in held.to_pylist():
            items, docs, scores = (np.frombuffer(row[c], kind) for c, kind in (("items", "<i4"), ("docs", "<i8"), ("scores", "<i8")))
            shard, at = docs >> 20, docs & ((1 << 20) - 1)
            doc_id, known = np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
            for s in np.unique(shard).tolist():
                m = shard == s
                doc_id[m], known[m] = ids[s][0][at[m]], ids[s][1][at[m]] > 0
            order = np.lexsort((docs, doc_id, ~known, -scores, items))
            nth = np.arange(len(order)) - np.searchsorted(items[order], items[order])
            order = order[nth < k]
            columns = [pa.array(np.full(len(order), row["bundle"]), pa.int64()), pa.array(items[order]), pa.array(docs[order])]
            columns += [pa.array(doc_id[order], mask=~known[order]), pa.array(scores[order])]
            out.append(pa.table(columns, names=list(kinds)))
        return pa.concat_tables(out).combine_chunks() if out else pa.table({n: pa.array([], t) for n, t in kinds.items()})

    return run


def _cuts(mass: np.ndarray, owners: int) -> np.ndarray:
    """Where bands end, in slots sorted by frequency, so that the items' weights are shared out evenly."""
    share = np.cumsum(mass) / max(mass.sum(), 1)
    return np.minimum((share * owners - 1e-9).astype(np.int64), owners - 1)


def search(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    folder = run_dir(spark, "lexical")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    key = items.schema["item_id"].dataType.simpleString()
    doc_key = docs.schema["doc_id"].dataType.simpleString()
    empty = f"item_id {key}, rank int, doc_id {doc_key}, score long"

    numbered = f"bundle long, item int, item_id {key}, text string"
    items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_items(s.bundle), numbered).write.parquet(f"{folder}/items")
    given = read("items", numbered)
    given.mapInArrow(_item_terms, ITEM_TERMS).write.parquet(f"{folder}/terms")
    item_terms = read("terms", ITEM_TERMS)
    slot = F.col("term").bitwiseAND(F.lit(SLOTS - 1))
    used = item_terms.select(slot.cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()  # at most SLOTS rows
    bits = np.zeros(SLOTS, bool)
    bits[used] = True
    bitmap = spark.sparkContext.broadcast(np.packbits(bits))
    docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_shards(bitmap, s.shard_bytes), SHARD).write.parquet(f"{folder}/shards")
    shards = read("shards", SHARD)
    size = sum(F.octet_length(c) for c in ("docs", "tfs", "sizes")).cast("long")
    facts = shards.agg(*[F.sum(c).alias(c) for c in ("documents", "words")], F.sum(size).alias("bytes")).first()
    bundles = given.agg(F.count_distinct("bundle").alias("n")).first()["n"]
    if not facts["bytes"] or not len(used):
        return spark.createDataFrame([], empty)
    totals = Totals(facts["documents"], facts["words"])
    groups = max(1, ceil(facts["bytes"] / s.group_bytes))

    # Document frequency and weight of the items' terms; each slot's band.
    df = shards.select("terms", "counts").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = (F.lit(2.0) * totals.documents + 2) / (F.lit(2.0) * F.col("df") + 1)
    weighed = item_terms.join(df, "term").withColumn("weight", F.floor(F.lit(1000.0) * F.log(ratio)))
    weighed.write.parquet(f"{folder}/weighed")
    weighed = read("weighed", "term long, bundle long, item int, df long, weight long")
    per_slot = weighed.groupBy(slot.cast("int").alias("slot")).agg(F.max("df").alias("df"), F.sum("weight").alias("mass")).toArrow()
    at, frequency, mass = (per_slot.column(c).to_numpy() for c in ("slot", "df", "mass"))  # at most SLOTS rows
    order = np.lexsort((at, frequency))
    band_of = np.full(SLOTS, s.owners, np.uint8)
    band_of[at[order]] = _cuts(mass[order].astype(np.float64), s.owners)
    bands = spark.sparkContext.broadcast(band_of)
    shards.select("shard", "terms", "counts", "docs", "tfs", "sizes").mapInArrow(_banded(bands, s.owners), BANDED).write.partitionBy(
        "band"
    ).parquet(f"{folder}/banded")
    banded = read("banded", BANDED)

    # For each owner: an item's terms, and the most that later owners can add.
    def band_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = bands.value[_slot(batch.column("term").to_numpy().view(np.uint64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band, pa.int32())], names=[*batch.schema.names, "band"])

    by_band = weighed.select("bundle", "item", "term", "weight").mapInArrow(band_numbers, "bundle long, item int, term long, weight long, band int")
    by_band.write.parquet(f"{folder}/plan")
    by_band = read("plan", "bundle long, item int, term long, weight long, band int")
    to_groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")
    to_bundles = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))).alias("b")
    bundle_of = F.pmod(F.xxhash64("bundle"), F.lit(bundles)).alias("b")
    group_of = F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("g")
    plan_type = "array<struct<item:int,least:long,rest:long,terms:array<struct<term:long,weight:long>>>>"

    carried = None
    for band in range(s.owners):
        now = F.col("band") == band
        plan = by_band.groupBy("bundle", "item").agg(
            F.coalesce(F.sum(F.when(F.col("band") > band, F.col("weight") * MOST)), F.lit(0)).alias("rest"),
            F.array_sort(F.collect_list(F.when(now, F.struct("term", "weight")))).alias("terms"),
        )
        if carried is None:
            plan = plan.withColumn("least", F.lit(0).cast("long"))
        else:
            nth = F.row_number().over(Window.partitionBy("bundle", "item").orderBy(F.desc("score")))
            tops = carried.select("bundle", "tops").mapInArrow(_tops, "bundle long, item int, score long")
            least = tops.withColumn("nth", nth).where(F.col("nth") <= s.k).groupBy("bundle", "item").agg(
                F.max(F.when(F.col("nth") == s.k, F.col("score"))).alias("least")
            )
            plan = plan.join(least, ["bundle", "item"], "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
        planned = plan.groupBy("bundle").agg(F.collect_list(F.struct("item", "least", "rest", "terms")).cast(plan_type).alias("plan"))
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("items", "docs", "scores")]
        left = planned.select(bundle_of, "bundle", "plan", *nothing).select("b", to_groups, "bundle", "plan", "items", "docs", "scores")
        if carried is not None:
            left = left.unionByName(carried.select("b", "g", "bundle", F.lit(None).cast(plan_type).alias("plan"), "items", "docs", "scores"))
        right = banded.where(now).drop("band").select(group_of, "*").select(to_bundles, "*")
        stage = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(_stage(totals, s.k), CARRIED)
        stage.write.parquet(f"{folder}/stage-{band}")
        carried = read(f"stage-{band}", CARRIED)

    documents = shards.select(group_of, "shard", "ids", "known").select(to_bundles, "*")
    last = carried.where(F.octet_length("docs") > 0).select("b", "g", "bundle", "items", "docs", "scores")
    chosen = last.groupBy("b", "g").cogroup(documents.groupBy("b", "g")).applyInArrow(_select(s.k), SELECTED)
    nth = F.row_number().over(
        Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    )
    ranked = chosen.withColumn("rank", nth).where(F.col("rank") <= s.k)
    return ranked.join(given.drop("text"), ["bundle", "item"]).select("item_id", "rank", F.col("doc_id").cast(doc_key).alias("doc_id"), "score")


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS k FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
sized AS (SELECT doc_id, CAST(len(k) AS BIGINT) AS n FROM d WHERE len(k) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
places AS (SELECT doc_id, unnest(k) AS t FROM d),
postings AS (SELECT doc_id, t, count(*) AS tf FROM places WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, total GROUP BY t),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM i JOIN postings USING (t) JOIN weights USING (t) JOIN sized USING (doc_id), total GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM scores WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 10
"""
