"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct shingles of five words. Two documents
link when 100 * intersection >= 80 * union.

1. Tokens (shingles) are counted over all documents: shards count theirs and
   send them, packed, to the bucket of the token's hash, which returns the
   order of magnitude of each count. Tokens are ordered by it, rare ones first.
2. Two linked sets of size n share at least ceil(0.8 n) tokens, so they share
   at least l of the first n - ceil(0.8 n) + l tokens of each, for every l.
   Each document takes the l with the least estimated cost (posting lists to
   read, and candidates to verify): a longer prefix costs more lookups but asks
   for more shared tokens. A document that has fewer than l tokens in such a
   prefix that occur elsewhere has no partner.
3. Equal sets are one node. Nodes that share a prefix token, over any number of
   steps, form a family; no link leaves one. A family is joined in a task: an
   inverted index counts shared prefix tokens, pairs with at least the smaller
   l are verified on the whole sets unless links already connect them. A large
   family is dealt into blocks of ``block`` nodes and each pair of blocks is a
   task, so all its pairs are still covered. A task returns a spanning star of
   each group it found, not its pairs.
4. Connected components of these links give the result.

Texts are dealt into shards by a hash of id and text, once; the sets of the few
documents with a possible partner are written to the shared folder.

Cases: a null text or one without words has the empty set and links with
nothing; with fewer than five words, the whole sequence is the only shingle;
rows that share an id are documents of their own; component ids ignore null
ids (null where there is no other); extra columns are ignored by ``join`` and
kept by ``keep_one``, whatever their names, which keeps the row with the
smallest id (null first; of rows that share it always the same one) of each
component and all rows without words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.llm import bytesio as B
from opinionlake.llm import shards as S
from opinionlake.llm.components import components
from opinionlake.llm.registry import ORACLES, query, table
from opinionlake.session import run_dir

SHINGLE = 5
PERCENT = 80
# Candidate values of l, and what verifying costs against reading one posting.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
VERIFY = 0.5
BLOCK = 1000

COUNTS = "bucket long, shard long, keys binary, counts binary"
ORDERS = "shard long, bucket long, orders binary"
PROFILE = (
    "shard long, place long, doc_id long, n_shingles long, sig binary, matches long, tokens binary, members binary"
)


def shingle_sets(col) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    w = S.words(col, lower=True)
    edges = np.searchsorted(w.doc, np.arange(len(col) + 1))
    out = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        words = w.hashes[lo:hi]
        if len(words) >= SHINGLE:
            out.append(np.unique(B.grams(words, SHINGLE)))
        elif len(words):
            # The number of words keeps short sequences apart from shingles.
            out.append(B.mix(B.grams(words, len(words)) + np.uint64(len(words))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _shard_tokens(sets: list[np.ndarray], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens of a shard ordered by bucket, their counts over distinct sets, bucket edges)."""
    distinct = {s.tobytes(): s for s in sets if len(s)}
    every = np.concatenate(list(distinct.values())) if distinct else np.zeros(0, np.uint64)
    tokens, counts = np.unique(every, return_counts=True)
    order, edges = S.split_by((tokens % np.uint64(n_buckets)).astype(np.int64), n_buckets)
    return tokens[order], counts[order].astype(np.uint32), edges


def _text(docs: pa.Table):
    col = docs.column("text")
    return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())


def _count(n_buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        docs = S.ordered(docs)
        tokens, counts, edges = _shard_tokens(shingle_sets(_text(docs)), n_buckets)
        used = [b for b in range(n_buckets) if edges[b] < edges[b + 1]]
        short = (tokens >> np.uint64(32)).astype(np.uint32)
        cut = lambda x: [x[edges[b] : edges[b + 1]].tobytes() for b in used]
        return S.pack(
            {
                "bucket": (pa.int64(), used),
                "shard": (pa.int64(), [docs.column(S.SHARD)[0].as_py()] * len(used)),
                "keys": (pa.binary(), cut(short)),
                "counts": (pa.binary(), cut(counts)),
            }
        )

    return run


def _order(rows: pa.Table) -> pa.Table:
    """For each shard's tokens of this bucket, in its order, the order of magnitude of their count (0: once)."""
    keys, counts = S.unpack(rows.column("keys"), np.uint32), S.unpack(rows.column("counts"), np.uint32)
    sizes = S.lengths(rows.column("keys"), np.uint32)
    _, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, weights=counts) if len(keys) else np.zeros(0)
    size = np.log2(np.maximum(total, 1)).astype(np.uint8)[back]
    ends = np.cumsum(sizes)
    found = [size[e - n : e].tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return S.pack(
        {
            "shard": (pa.int64(), rows.column("shard").to_pylist()),
            "bucket": (pa.int64(), rows.column("bucket").to_pylist()),
            "orders": (pa.binary(), found),
        }
    )


def prefix(tokens: np.ndarray, size: np.ndarray) -> tuple[int, np.ndarray] | None:
    """(l, the tokens of the l-prefix that occur elsewhere too), or None where no partner is possible."""
    n = len(tokens)
    least = (PERCENT * n + 99) // 100
    order = np.lexsort((tokens, size))
    s = size[order].astype(np.int64)
    shared = np.cumsum(s > 0)
    cost = np.cumsum(np.where(s > 0, 2.0**s, 0.0))
    best = None
    for matches in MATCHES:
        end = n - least + matches
        if matches > least:
            break
        if shared[end - 1] < matches:
            return None
        price = cost[end - 1] * (1 + VERIFY * n / matches)
        if best is None or price < best[0]:
            best = (price, matches, end)
    _, matches, end = best
    taken = order[:end]
    return matches, tokens[taken[size[taken] > 0]]


def _profile(n_buckets: int):
    def run(docs: pa.Table, orders: pa.Table) -> pa.Table:
        docs = S.ordered(docs)
        sets = shingle_sets(_text(docs))
        tokens, _, edges = _shard_tokens(sets, n_buckets)
        size = np.zeros(len(tokens), np.uint8)
        for b, found in zip(orders.column("bucket").to_pylist(), orders.column("orders").to_pylist(), strict=True):
            size[edges[b] : edges[b + 1]] = np.frombuffer(found, np.uint8)
        by_token = np.argsort(tokens)
        tokens, size = tokens[by_token], size[by_token]
        n, sigs, matches, heads, members = [], [], [], [], []
        seen: set[bytes] = set()
        for own in sets:
            n.append(len(own))
            sig = signature(own) if len(own) else None
            sigs.append(sig)
            found = None
            if sig is not None and sig not in seen:
                seen.add(sig)
                found = prefix(own, size[np.searchsorted(tokens, own)])
            matches.append(found[0] if found else None)
            heads.append(found[1].tobytes() if found else None)
            members.append(own.tobytes() if found else None)
        return pa.table(
            {
                "shard": docs.column(S.SHARD),
                "place": pa.array(range(docs.num_rows), pa.int64()),
                "doc_id": docs.column("doc_id"),
                "n_shingles": pa.array(n, pa.int64()),
                "sig": pa.array(sigs, pa.binary()),
                "matches": pa.array(matches, pa.int64()),
                "tokens": pa.array(heads, pa.binary()),
                "members": pa.array(members, pa.binary()),
            }
        )

    return run


def _explode(batches):
    """(token, sig) of each node's prefix."""
    for batch in batches:
        tokens = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
        sizes = [len(x) for x in tokens]
        at = np.repeat(np.arange(len(tokens)), sizes)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        for lo in range(0, len(flat), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[lo : lo + 100_000]), batch.column("sig").take(pa.array(at[lo : lo + 100_000]))],
                names=["token", "sig"],
            )


LINKS = "a binary, b binary"


def link_groups(sets: list[np.ndarray], heads: list[np.ndarray], matches: list[int], side: list[int]) -> list[int]:
    """For each set, the smallest index of its group: sets connected by links, in one block or across two.

    With two sides, only pairs of different sides are compared.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tokens = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    size, need = np.array([len(s) for s in sets]), np.array(matches)
    sides = np.array(side)
    two = len(set(side)) > 1
    for x in range(len(sets)):
        lo, hi = np.searchsorted(tokens, heads[x], "left"), np.searchsorted(tokens, heads[x], "right")
        lists = [of[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        if not lists:
            continue
        others, shared = np.unique(np.concatenate(lists), return_counts=True)
        fit = (others < x) & (shared >= np.minimum(need[others], need[x]))
        fit &= 100 * np.minimum(size[others], size[x]) >= PERCENT * np.maximum(size[others], size[x])
        if two:
            fit &= sides[others] != sides[x]
        # Most shared tokens first: a link found early saves the pairs it connects.
        for y in others[fit][np.argsort(-shared[fit], kind="stable")].tolist():
            a, b = root(x), root(y)
            if a == b:
                continue
            small, large = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
            slot = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[slot] == small).sum())
            if 100 * both >= PERCENT * (size[x] + size[y] - both):
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def _join(nodes: pa.Table) -> pa.Table:
    """Links (node, smallest node of its group) within one family or a pair of its blocks."""
    nodes = nodes.combine_chunks()
    sigs = nodes.column("sig").to_pylist()
    order = sorted(range(len(sigs)), key=lambda i: sigs[i])
    sigs = [sigs[i] for i in order]
    pick = lambda name: [nodes.column(name)[i].as_py() for i in order]
    sets = [np.frombuffer(x, np.uint64) for x in pick("members")]
    heads = [np.frombuffer(x, np.uint64) for x in pick("tokens")]
    roots = link_groups(sets, heads, pick("matches"), pick("block"))
    pairs = [(sigs[i], sigs[r]) for i, r in enumerate(roots) if i != r]
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})


class Groups:
    """Profile of all rows (shard, place, doc_id, n_shingles, sig) and the root of each linked signature."""

    def __init__(self, docs: DataFrame, shard_bytes: int = S.SHARD_BYTES, block: int = BLOCK) -> None:
        spark = docs.sparkSession
        folder = run_dir(spark, "jaccard")
        self.shards = S.count_shards(docs, shard_bytes)
        by_shard = S.dealt(docs.select("doc_id", "text"), self.shards).groupBy(S.SHARD)
        counts = by_shard.applyInArrow(B.lean(_count(S.buckets(self.shards))), COUNTS)
        orders = counts.groupBy("bucket").applyInArrow(B.lean(_order), ORDERS)
        profiled = B.lean(_profile(S.buckets(self.shards)))
        profile = by_shard.cogroup(orders.groupBy("shard")).applyInArrow(profiled, PROFILE)
        profile.write.parquet(f"{folder}/profile")
        every = spark.read.schema(PROFILE).parquet(f"{folder}/profile")
        self.rows = every.select("shard", "place", "doc_id", "n_shingles", "sig")

        nodes = every.where("tokens IS NOT NULL").select("sig", "matches", "tokens", "members").dropDuplicates(["sig"])
        tokens = nodes.select("sig", "tokens").mapInArrow(_explode, "token long, sig binary")
        tokens.write.parquet(f"{folder}/tokens")
        tokens = spark.read.schema("token long, sig binary").parquet(f"{folder}/tokens")
        leaders = tokens.groupBy("token").agg(F.min("sig").alias("b"), F.max("sig").alias("top")).where("b < top")
        families = components(tokens.join(leaders, "token").select(F.col("sig").alias("a"), "b"))
        members = families.unionByName(families.select(F.col("b").alias("a"), "b").distinct())
        sizes = members.groupBy("b").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        own, other = F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        # A node goes to every pair of blocks that its own block is part of. Sets join these light rows by node, and
        # are dealt by family and pair, so that a large family is spread over many tasks.
        places = (
            members.join(sizes, "b")
            .select(F.col("a").alias("sig"), F.col("b").alias("family"), own, F.explode(other).alias("other"))
            .select("sig", "family", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
        )
        dealt = nodes.join(places, "sig").repartition("family", "p", "q")
        links = dealt.groupBy("family", "p", "q").applyInArrow(_join, LINKS)
        self.roots = components(links)


def _labelled(groups: Groups) -> DataFrame:
    """(sig, root) of every signature."""
    known = groups.rows.where("sig IS NOT NULL").select("sig").distinct()
    return known.join(groups.roots.withColumnRenamed("a", "sig"), "sig", "left").select(
        "sig", F.coalesce("b", "sig").alias("root")
    )


def join(docs: DataFrame, shard_bytes: int = S.SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    g = Groups(docs, shard_bytes, block)
    smallest = g.rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("first")).join(_labelled(g), "sig")
    ids = smallest.groupBy("root").agg(F.min("first").alias("component_id"))
    by_sig = smallest.join(ids, "root").select("sig", "component_id")
    return g.rows.join(by_sig, "sig", "left").select(
        "doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _only(docs: pa.Table, kept: pa.Table) -> pa.Table:
    docs = S.ordered(docs)
    return docs.take(pa.array(sorted(kept.column("place").to_pylist()), pa.int64())).drop_columns([S.SHARD])


def keep_one(docs: DataFrame, shard_bytes: int = S.SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one of each component stays."""
    g = Groups(docs, shard_bytes, block)
    first = F.min(F.struct("doc_id", "shard", "place")).alias("first")
    smallest = g.rows.where("sig IS NOT NULL").groupBy("sig").agg(first).join(_labelled(g), "sig")
    kept = smallest.groupBy("root").agg(F.min("first").alias("first")).select("first.shard", "first.place")
    kept = kept.unionByName(g.rows.where("sig IS NULL").select("shard", "place"))
    given = S.dealt(docs, g.shards).groupBy(S.SHARD)
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(S.dealt(docs, 1).columns, docs.schema.fields, strict=False)])
    return given.cogroup(kept.groupBy("shard")).applyInArrow(B.lean(_only), schema).toDF(*docs.columns)


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS k
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(k, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, k, unnest(range(1, greatest(len(k) - 4, 1) + 1)) AS i FROM w WHERE len(k) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
reach AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
SELECT doc_id, coalesce(any_value(size), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
