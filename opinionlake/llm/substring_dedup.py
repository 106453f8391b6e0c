"""Substring dedup with repeated-phrase automata.

A window is 20 consecutive words of a document. Every word covered by a window
whose word sequence also starts earlier (smaller id, or same document, earlier
start) is removed.

1. Of the phrases of five words inside a window, the one with the smallest hash
   marks it, so equal windows are marked by equal phrases. Shards count their
   marking phrases; phrases seen more than once recur.
2. One shard that holds a recurring phrase, the smallest, confirms it: it gives
   the phrase's words, which go to every shard that counted the phrase.
3. Each shard compiles the phrases it was sent into Aho-Corasick automata (so
   the automata are sharded, each with the phrases that can occur in its
   documents) and streams all its documents through them. Only this locates the
   places of recurring phrases; windows marked at such a place are candidates.
4. Candidates are compared by a 128-bit hash of their words: a shard keeps the
   first of each and sends it to the bucket of the hash, where the first of all
   shards is found. All others are copies.
5. Shards cut the words that copies cover.

Texts are shuffled once (the four steps over documents share the exchange) and
are dealt by a hash of id and text, so a passage that a third of all documents
share, or an id that a third of all rows have, is spread over all shards; it reaches its bucket once per shard. Numbers travel
as packed arrays. No group holds more than a shard of text or a bucket of
numbers; an automaton holds at most ``patterns`` phrases at a time.

Cases: a null or empty text has no words; texts of fewer than 20 words are
kept; rows that share an id are taken one after the other, by a hash of their
text, as one document whose windows don't cross rows, and each row is returned;
a null id comes before all others. Extra columns are carried along untouched,
whatever their names.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.llm import bytesio as B
from opinionlake.llm import shards as S
from opinionlake.llm.registry import ORACLES, query, table

WINDOW, PHRASE = 20, 5
REACH = WINDOW - PHRASE + 1
PATTERNS = 60_000

COUNTS = "bucket long, shard long, keys binary, many binary"
ASKED = "shard long, bucket long, keys binary"
CONFIRMED = "bucket long, keys binary, phrases binary"
PHRASES = "shard long, phrases binary"
FIRSTS = "bucket long, shard long, hi binary, lo binary, docs binary, rows binary, places binary"
COPIES = "shard long, docs binary, rows binary, places binary"
# The hash of a row's text, by which rows that share an id are ordered.
ROW = "llm__row"

NO_ID = np.iinfo(np.int64).min


def marks(w: S.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows, place of the phrase that marks each one, hashes of all phrases)."""
    phrase = B.grams(w.hashes, PHRASE)
    n = len(w.hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), phrase
    # The low bits hold the place within the window, so the first of equal phrases is the smallest.
    low = np.uint64(REACH - 1)
    high = phrase & ~low
    least = high[:n].copy()
    for i in range(1, REACH):
        np.minimum(least, high[i : i + n] | np.uint64(i), out=least)
    starts = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1 :])
    return starts, starts + (least[starts] & low).astype(np.int64), phrase


def _count(n_buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        docs = S.ordered(docs)
        shard = docs.column(S.SHARD)[0].as_py()
        _, place, phrase = marks(S.words(docs.column("text")))
        keys, counts = np.unique(phrase[np.unique(place)], return_counts=True)
        order, edges = S.split_by((keys % np.uint64(n_buckets)).astype(np.int64), n_buckets)
        keys, many = keys[order], (counts[order] > 1).astype(np.uint8)
        used = [b for b in range(n_buckets) if edges[b] < edges[b + 1]]
        return S.pack(
            {
                "bucket": (pa.int64(), used),
                "shard": (pa.int64(), [shard] * len(used)),
                "keys": (pa.binary(), [keys[edges[b] : edges[b + 1]].tobytes() for b in used]),
                "many": (pa.binary(), [many[edges[b] : edges[b + 1]].tobytes() for b in used]),
            }
        )

    return run


def _recurring(rows: pa.Table) -> pa.Table:
    """The phrases of a bucket that occur more than once anywhere, each asked of the smallest shard that holds it."""
    keys, many = S.unpack(rows.column("keys"), np.uint64), S.unpack(rows.column("many"), np.uint8)
    shard = np.repeat(rows.column("shard").to_numpy(), S.lengths(rows.column("keys"), np.uint64))
    order = np.lexsort((shard, keys))
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    again = many[order] > 0
    again[:-1] |= ~first[1:]
    asked = order[first & again]
    owners, at = np.unique(shard[asked], return_inverse=True)
    parts, edges = S.split_by(at, len(owners))
    asked = keys[asked[parts]]
    return S.pack(
        {
            "shard": (pa.int64(), owners.tolist()),
            "bucket": (pa.int64(), [rows.column("bucket")[0].as_py()] * len(owners)),
            "keys": (pa.binary(), [asked[edges[i] : edges[i + 1]].tobytes() for i in range(len(owners))]),
        }
    )


def _confirm(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """The words of the phrases that a shard is asked for, a line each, in the order of the keys."""
    buckets, keys, phrases = [], [], []
    if docs.num_rows and asked.num_rows:
        w = S.words(S.ordered(docs).column("text"))
        _, place, phrase = marks(w)
        marked = np.unique(place)
        own, first = np.unique(phrase[marked], return_index=True)
        for bucket, wanted in zip(asked.column("bucket").to_pylist(), asked.column("keys").to_pylist(), strict=True):
            spots = marked[first[np.searchsorted(own, np.frombuffer(wanted, np.uint64))]]
            spans = zip(w.starts[spots].tolist(), w.ends[spots + PHRASE - 1].tolist(), strict=True)
            buckets.append(bucket)
            keys.append(wanted)
            phrases.append(b"\n".join([b" ".join(w.data[lo:hi].tobytes().split()) for lo, hi in spans]))
    return S.pack({"bucket": (pa.int64(), buckets), "keys": (pa.binary(), keys), "phrases": (pa.binary(), phrases)})


def _deliver(rows: pa.Table, confirmed: pa.Table) -> pa.Table:
    """Per shard, the confirmed phrases among those it counted."""
    shards, phrases = [], []
    if rows.num_rows and confirmed.num_rows:
        keys = S.unpack(confirmed.column("keys"), np.uint64)
        lines = [line for x in confirmed.column("phrases").to_pylist() for line in x.split(b"\n")]
        order = np.argsort(keys)
        keys = keys[order]
        for shard, held in zip(rows.column("shard").to_pylist(), rows.column("keys").to_pylist(), strict=True):
            own = np.frombuffer(held, np.uint64)
            slot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found = order[slot[keys[slot] == own]].tolist()
            if found:
                shards.append(shard)
                phrases.append(b"\n".join([lines[i] for i in found]))
    return S.pack({"shard": (pa.int64(), shards), "phrases": (pa.binary(), phrases)})


def locate(w: S.Words, n_docs: int, phrases: list[str]) -> np.ndarray:
    """Word places at which any of the phrases stands, found by automata of at most PATTERNS phrases."""
    found = []
    edges = np.searchsorted(w.doc, np.arange(n_docs + 1))
    lines = []
    for d in range(n_docs):
        lo, hi = int(edges[d]), int(edges[d + 1])
        if hi - lo >= WINDOW:
            text = w.data[w.starts[lo] : w.ends[hi - 1]].tobytes()
            lines.append((lo, hi, f" {b' '.join(text.split()).decode('latin-1')} "))
    for i in range(0, len(phrases), PATTERNS):
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases[i : i + PATTERNS]:
            machine.add_word(phrase)
        machine.make_automaton()
        for lo, hi, line in lines:
            ends = np.fromiter((end for end, _ in machine.iter(line)), np.int64)
            if len(ends):
                spaces = np.cumsum(w.ends[lo:hi] - w.starts[lo:hi] + 1)
                found.append(lo + np.searchsorted(spaces, ends) - (PHRASE - 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ordered(docs: pa.Table) -> pa.Table:
    """Rows by id (null first), then by the hash of their text."""
    docs = docs.combine_chunks()
    plain = pa.table({"id": docs.column("doc_id"), "row": docs.column(ROW)})
    return docs.take(pc.sort_indices(plain, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_start")).combine_chunks()


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _runs(docs: pa.Table) -> np.ndarray:
    """For each row of ordered rows the first one with the same id and text."""
    ids, rows = _ids(docs), docs.column(ROW).to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))


def _word_places(w: S.Words, docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each word of a shard; equal rows are one, their words counted on."""
    of = _runs(docs)[w.doc]
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    return of, np.arange(len(of)) - begin


def _firsts(n_buckets: int):
    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        kinds = dict.fromkeys(("bucket", "shard"), pa.int64()) | dict.fromkeys(("hi", "lo", "docs", "rows", "places"), pa.binary())
        empty = S.pack({name: (kind, []) for name, kind in kinds.items()})
        if not docs.num_rows or not confirmed.num_rows:
            return empty
        docs = _ordered(docs)
        shard = docs.column(S.SHARD)[0].as_py()
        w = S.words(docs.column("text"))
        starts, place, _ = marks(w)
        phrases = {f" {x.decode('latin-1')} " for lines in confirmed.column("phrases").to_pylist() for x in lines.split(b"\n")}
        located = np.zeros(len(w.hashes) + 1, bool)
        located[locate(w, docs.num_rows, sorted(phrases))] = True
        starts = starts[located[place]]
        if not len(starts):
            return empty
        hi = B.grams(w.hashes, WINDOW)[starts]
        lo = B.grams(B.mix(w.hashes ^ B.BASE), WINDOW)[starts]
        of, at = _word_places(w, docs)
        of, row = _ids(docs)[of], docs.column(ROW).to_numpy()[of]
        # Stable sorts keep the order of documents and places among equal windows.
        order = np.lexsort((lo, hi))
        h, g = hi[order], lo[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        own = np.sort(starts[order[~new]])
        firsts = np.sort(order[new])
        part, edges = S.split_by((lo[firsts] % np.uint64(n_buckets)).astype(np.int64), n_buckets)
        firsts = firsts[part]
        used = [b for b in range(n_buckets) if edges[b] < edges[b + 1]]
        cut = lambda x: [x[edges[b] : edges[b + 1]].tobytes() for b in used]
        # The shard's own copies need no comparison: their row passes through to the shard.
        return S.pack(
            {
                "bucket": (pa.int64(), [*used, -1 - shard]),
                "shard": (pa.int64(), [shard] * (len(used) + 1)),
                "hi": (pa.binary(), [*cut(hi[firsts]), b""]),
                "lo": (pa.binary(), [*cut(lo[firsts]), b""]),
                "docs": (pa.binary(), [*cut(of[starts[firsts]]), of[own].tobytes()]),
                "rows": (pa.binary(), [*cut(row[starts[firsts]]), row[own].tobytes()]),
                "places": (pa.binary(), [*cut(at[starts[firsts]].astype(np.uint32)), at[own].astype(np.uint32).tobytes()]),
            }
        )

    return run


def _copies(rows: pa.Table) -> pa.Table:
    """Per shard, the windows that an earlier one equals."""
    if rows.column("bucket")[0].as_py() < 0:
        return rows.select(["shard", "docs", "rows", "places"])
    hi, lo = (S.unpack(rows.column(c), np.uint64) for c in ("hi", "lo"))
    docs, row = (S.unpack(rows.column(c), np.int64) for c in ("docs", "rows"))
    places = S.unpack(rows.column("places"), np.uint32)
    order = np.lexsort((places, row, docs, lo, hi))
    h, g = hi[order], lo[order]
    copy = np.zeros(len(order), bool)
    copy[order[1:]] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    sizes = S.lengths(rows.column("hi"), np.uint64)
    ends = np.cumsum(sizes)
    cut = lambda x: [x[e - n : e][copy[e - n : e]].tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    found = {"docs": (pa.binary(), cut(docs)), "rows": (pa.binary(), cut(row)), "places": (pa.binary(), cut(places))}
    return S.pack({"shard": (pa.int64(), rows.column("shard").to_pylist()), **found})


MORE = ["dedup__n_words", "dedup__n_removed", "dedup__sha256"]


def _cut(names: list[str]):
    """Rows of a shard with their words counted and the covered ones taken out of the text."""

    def run(docs: pa.Table, copies: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        w = S.words(docs.column("text"))
        covered = np.zeros(len(w.hashes) + 1, np.int32)
        if copies.num_rows:
            runs = _runs(docs)
            begin = np.searchsorted(w.doc, np.arange(docs.num_rows))
            ids, rows = _ids(docs).tolist(), docs.column(ROW).to_pylist()
            at = {(ids[r], rows[r]): int(begin[r]) for r in np.unique(runs).tolist()}
            doc, row = (S.unpack(copies.column(c), np.int64) for c in ("docs", "rows"))
            place = S.unpack(copies.column("places"), np.uint32).astype(np.int64)
            order = np.lexsort((row, doc))
            new = np.ones(len(order), bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1])
            starts = np.array([at[k] for k in zip(doc[order][new].tolist(), row[order][new].tolist(), strict=True)], np.int64)
            start = starts[np.cumsum(new) - 1] + place[order]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + WINDOW, -1)
        gone = np.cumsum(covered)[:-1] > 0
        edges = np.searchsorted(w.doc, np.arange(docs.num_rows + 1))
        texts, digests, removed = [], [], []
        original = docs.column("text").to_pylist()
        for d in range(docs.num_rows):
            lo, hi = int(edges[d]), int(edges[d + 1])
            cut = int(gone[lo:hi].sum())
            kept = w.data[w.starts[lo] : w.ends[hi - 1]].tobytes().split() if hi > lo else []
            if cut:
                keep = ~gone[lo:hi]
                kept = [x for x, k in zip(kept, keep.tolist(), strict=True) if k]
            line = b" ".join(kept)
            digests.append(hashlib.sha256(line).hexdigest())
            removed.append(cut)
            texts.append(line.decode() if cut else original[d])
        out = {name: docs.column(name) for name in names}
        out["text"] = pa.array(texts, pa.string())
        found = [pa.array(np.diff(edges), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.table({name: out[name] for name in names} | dict(zip(MORE, found, strict=True)))

    return run


def dedupe(docs: DataFrame, shard_bytes: int = S.SHARD_BYTES) -> DataFrame:
    """Every row of ``docs`` with repeated passages cut from its text, and three more columns.

    ``dedup__n_words``, ``dedup__n_removed``, ``dedup__sha256`` (of the kept words, joined by one space); a name that
    ``docs`` has already gets an underscore. A text of which nothing is removed stays as it is; otherwise it is its
    kept words joined by one space.
    """
    n = S.count_shards(docs, shard_bytes)
    given = S.dealt(docs, n).withColumn(ROW, F.xxhash64("text"))
    names = given.columns[: len(docs.columns)]
    by_shard = given.groupBy(S.SHARD)
    counts = by_shard.applyInArrow(B.lean(_count(S.buckets(n))), COUNTS)
    asked = counts.groupBy("bucket").applyInArrow(B.lean(_recurring), ASKED)
    confirmed = by_shard.cogroup(asked.groupBy("shard")).applyInArrow(B.lean(_confirm), CONFIRMED)
    phrases = counts.groupBy("bucket").cogroup(confirmed.groupBy("bucket")).applyInArrow(B.lean(_deliver), PHRASES)
    firsts = by_shard.cogroup(phrases.groupBy("shard")).applyInArrow(B.lean(_firsts(S.buckets(n))), FIRSTS)
    copies = firsts.groupBy("bucket").applyInArrow(B.lean(_copies), COPIES)
    own = [T.StructField(c, f.dataType) for c, f in zip(names, docs.schema.fields, strict=True)]
    more = T.StructType.fromDDL("dedup__n_words long, dedup__n_removed long, dedup__sha256 string").fields
    cut = by_shard.cogroup(copies.groupBy("shard")).applyInArrow(B.lean(_cut(names)), T.StructType([*own, *more]))
    return cut.toDF(*docs.columns, *S.free_names(docs.columns, MORE))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe(docs).select(
        "doc_id",
        F.col("dedup__n_words").alias("n_words"),
        F.col("dedup__n_removed").alias("n_removed"),
        F.col("dedup__sha256").alias("kept_sha256"),
    )


ORACLES["op3_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS k FROM documents),
places AS (SELECT doc_id, k, unnest(range(1, len(k) - 18)) AS i FROM w),
copies AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(list_slice(k, i, i + 19), ' ') AS g FROM places)
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM copies, (SELECT unnest(range(0, 20)) AS o)),
words AS (SELECT doc_id, unnest(k) AS x, generate_subscripts(k, 1) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS line FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(k) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM w LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
