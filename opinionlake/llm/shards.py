"""Documents dealt into shards of bounded size, and packed rows between them.

Operators that compare all documents work on shards: groups of whole documents
of about ``shard_bytes`` of text, dealt by a hash of id and text, so that no id
(a null one neither), source or group of copies can fill one; only rows equal in
both share a shard for certain. The caller's columns travel under names of our
own, so that none of them can clash. What shards must tell each other goes
through buckets: the numbers of one shard for one bucket travel as one row of
packed arrays, far smaller than a row for each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionlake.llm import bytesio as B

SHARD = "llm__shard"
SHARD_BYTES = 4 << 20


def count_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards the documents' bytes ask for."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(1, -(-total // shard_bytes))


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with the shard of each row, and with every column but ``doc_id`` and ``text`` named by its place."""
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names).withColumn(SHARD, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("long"))


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, with underscores added to those that are taken."""
    out, used = [], {c.lower() for c in taken}
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def buckets(shards: int) -> int:
    return shards // 4 + 1


class Words(NamedTuple):
    """The words of a shard's documents in order.

    data: all bytes; starts, ends: of each word in it; hashes: 64-bit; doc: index of the document (row of the table).
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray


def ordered(docs: pa.Table) -> pa.Table:
    """Rows by id (null first), then text (null first), so that a shard always reads the same."""
    docs = docs.combine_chunks()
    plain = pa.table({"id": docs.column("doc_id"), "text": docs.column("text")})
    at = pc.sort_indices(plain, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return docs.take(at).combine_chunks()


def words(col, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of an Arrow string column; with ``lower``, A-Z in lower case."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    data, at = B.column_bytes(col)
    base = int(at[0])
    data = data[base : int(at[-1])]
    if lower:
        data = B.LOWER[data]
    starts, ends, hashes, doc = [], [], [], []
    offset = 0
    for block in B.blocks(col, B.at_white):
        held = block._replace(data=B.LOWER[block.data]) if lower else block
        s, e, segment = B.word_bounds(held, B.WHITE)
        hashes.append(B.range_hash(B.prefix_sums(held.data), s, e))
        starts.append(s + offset)
        ends.append(e + offset)
        doc.append(block.rows[segment])
        offset += len(block.data)
    none = np.zeros(0, np.int64)
    join = lambda parts: np.concatenate(parts) if parts else none
    return Words(data, join(starts), join(ends), join(hashes).astype(np.uint64), join(doc))


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): entries sorted by bucket, and where each bucket begins and ends."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def pack(columns: dict[str, tuple[pa.DataType, list]]) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, (kind, values) in columns.items()})


def unpack(col, dtype) -> np.ndarray:
    """All packed arrays of a column, one after the other."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype)


def lengths(col, dtype) -> np.ndarray:
    return np.array([len(x) for x in col.to_pylist()], np.int64) // np.dtype(dtype).itemsize
