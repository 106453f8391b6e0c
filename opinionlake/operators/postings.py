"""Lexical retrieval over a written inverted index, without the driver.

Documents are read once and become shards of documents that are alike, so that
questions in another language, say, find none of their words in most shards: per
shard its words, and for each word the documents that hold it with their
unit-norm TF-IDF weights (all words of the corpus; no vocabulary limit). Inverse
document frequencies reach a shard by a join on its distinct words. A question's
words are weighed the same way, and questions travel in packed blocks. A task
holds one block and reads the shards of a part of the index from the written
table, one after the other, so the index is neither shuffled nor copied, and a
block leaves a part with the k best of each question only.

Inside a shard the words that many documents hold are rows of a table. Those that
many questions have are one matrix product for all of them; short lists are added
entry by entry; the other rows only for questions that they can still lift more
than a few documents of above the k-th score so far, in this shard or in those
before it. All this in single precision, with its rounding on the safe side: it
tells which documents may be among the best, and only of these the score is taken
exactly. Nothing is approximate.

A word that every document holds is spread over all shards. A shard has about
``SHARD_WORDS`` words of text, a part ``GROUP_BYTES`` of lists at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake.functions.text import word_tokens
from opinionlake.operators.neighbours import DIGITS, ranked
from opinionlake.profiles import NEIGHBOURS
from opinionlake.session import run_dir

SHARD_WORDS = 1 << 21
# Lists that one task reads through at most.
GROUP_BYTES = 1 << 30
# Documents of a shard at most; shards' words that are sorted at once, into how many kinds, by how many common words.
SHARD_DOCS, MIXED, KINDS, COMMON = 1 << 13, 4, 8, 64
# Kinds whose directions have more than this cosine are one.
ALIKE = 0.7
# Questions of a block, and their words.
BLOCK, BLOCK_WORDS = 1 << 14, 1 << 20
# A list is a row of the table from one document in so many; a row is multiplied for all questions if one in so many asks.
THIN, OFTEN = 16, 24
# Of a shard's documents, one in so many is looked up singly.
FEW = 32
# Questions by documents, and list entries, that are added up at once.
CELLS, ENTRIES = 1 << 20, 1 << 16
SHARD = "shard long, ids binary, terms array<string>, counts binary, docs binary, tfs binary"
INDEX = "shard long, ids binary, terms array<string>, counts binary, docs binary, weights binary"
ROOM, TINY = 2 * 10.0**-DIGITS, 1e-30


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _pieces(which: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``which`` in pieces with about ``ENTRIES`` of ``sizes``."""
    return np.split(which, np.flatnonzero(np.diff(np.cumsum(sizes[which]) // ENTRIES)) + 1)


def words_of(text: Column) -> Column:
    """Lower-case words of two or more letters and digits of any script."""
    return word_tokens(F.lower(text))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a source that would be read by fewer tasks than a shuffle has, dealt by ``key``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, key)


def _pairs(words) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, and per distinct (word, row), sorted: index of the word, row, how often)."""
    flat = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    key = flat.indices.to_numpy().astype(np.int64) * max(1, len(words)) + row
    both, tf = np.unique(key, return_counts=True)
    return flat.dictionary, both // max(1, len(words)), both % max(1, len(words)), tf


def _kinds(of: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """A kind for each of n documents, alike in how they use the commonest words: k-means of a sample, by direction."""
    if kinds < 2:
        return np.zeros(n, np.int64)
    held = np.bincount(of)
    column = np.full(len(held), -1)
    column[np.argsort(-held, kind="stable")[:COMMON]] = np.arange(min(COMMON, len(held)))
    some = column[of] >= 0
    x = np.zeros((n, COMMON), np.float32)
    x[doc[some], column[of[some]]] = np.sqrt(tf[some])
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    rng = np.random.default_rng(0)
    few = x[rng.permutation(n)[: 256 * kinds]]
    centre = few[:1]
    for _ in range(kinds - 1):
        apart = np.maximum(1 - (few @ centre.T).max(axis=1), 1e-9).astype(np.float64) ** 2
        centre = np.vstack([centre, few[rng.choice(len(few), p=apart / apart.sum())]])
    for _ in range(8):
        near = (few @ centre.T).argmax(axis=1)
        sums = np.stack([few[near == c].sum(axis=0) for c in range(kinds)])
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centre = np.where(size > 0, sums / np.maximum(size, 1e-9), centre)
    # Kinds that hardly differ are one.
    return (centre @ centre.T > ALIKE).argmax(axis=1)[(x @ centre.T).argmax(axis=1)]


def _shards(shard_words: int):
    """Shards of documents that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            sizes = np.nan_to_num(batch.column("words").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends, lo = np.cumsum(sizes), 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MIXED * shard_words, side="right"))
                hi = min(max(hi, lo + 1), batch.num_rows)
                terms, of, doc, tf = _pairs(batch.column("words").slice(lo, hi - lo))
                ids = batch.column("doc_id").slice(lo, hi - lo).to_numpy().astype("<i8")
                size = sizes[lo:hi]
                kind = _kinds(of, doc, tf, len(ids), min(KINDS, ceil(KINDS * int(size.sum()) / shard_words)))
                # Shards of one kind, by length: what a question can score in one is so bounded closely.
                order = np.lexsort((size, kind))
                filled = np.cumsum(size[order])
                cuts, at = [0], 0
                while at < len(order):
                    same = int(np.searchsorted(kind[order], kind[order[at]], side="right"))
                    to = int(np.searchsorted(filled, (filled[at - 1] if at else 0) + shard_words, side="right"))
                    at = min(max(to, at + 1), same, at + SHARD_DOCS)
                    cuts.append(at)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                doc = place[doc]
                shard = np.searchsorted(cuts, doc, side="right") - 1
                by = np.argsort((shard * len(terms) + of) * len(order) + doc)
                of, doc, tf = of[by], doc[by], tf[by]
                edges = np.searchsorted(shard[by], np.arange(len(cuts)))
                for i, (first, last) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    mine = slice(edges[i], edges[i + 1])
                    starts = np.flatnonzero(np.diff(of[mine], prepend=-1))
                    held, counts = of[mine][starts], np.diff(starts, append=edges[i + 1] - edges[i])
                    packed = [ids[order[first:last]], counts.astype("<u4"), (doc[mine] - first).astype("<u4"), tf[mine].astype("<u4")]
                    own, counts, docs, tfs = (pa.array([a.tobytes()], pa.binary()) for a in packed)
                    words = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), terms.take(pa.array(held)).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), own, words, counts, docs, tfs], names=["shard", "ids", "terms", "counts", "docs", "tfs"])
                    number += 1
                lo = hi

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, place, term, df) of the distinct words of each shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            terms = batch.column("terms")[i].values
            counts = np.frombuffer(batch.column("counts")[i].as_py(), "<u4")
            columns = [pa.array(np.full(len(terms), batch.column("shard")[i].as_py())), pa.array(np.arange(len(terms)), pa.int32()), terms]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=["shard", "place", "term", "df"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with unit-norm weights in place of counts of words."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("shard", "ids", "counts", "docs", "tfs")}
            counts, docs, tf = (np.frombuffer(row[c], "<u4") for c in ("counts", "docs", "tfs"))
            given = batch.column("idf")[i].values
            idf = np.empty(len(counts))
            idf[given.field("place").to_numpy()] = given.field("idf").to_numpy()
            w = tf * np.repeat(idf, counts)
            norm = np.sqrt(np.bincount(docs, w * w, minlength=len(row["ids"]) // 8))
            w = w / norm[docs]
            out = [pa.array([row["shard"]], pa.int64()), pa.array([row["ids"]], pa.binary()), batch.column("terms").slice(i, 1)]
            out += [pa.array([row["counts"]], pa.binary()), pa.array([row["docs"]], pa.binary()), pa.array([w.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["shard", "ids", "terms", "counts", "docs", "weights"])


def _blocks(block: int, block_words: int):
    """Questions in packed blocks: number within the partition, ids, words per question, words, weights; and of each
    block the number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names = 0, ["block", "query_ids", "sizes", "words", "shares"]
        for batch in batches:
            ends, lo = np.cumsum(batch.column("terms").value_lengths().to_numpy().astype(np.int64)), 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + block_words, side="right"))
                hi = min(max(hi, lo + 1), lo + block, batch.num_rows)
                some = batch.slice(lo, hi - lo)
                terms, weights = some.column("terms"), some.column("weights")
                whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                sizes = terms.value_lengths().cast(pa.int32())
                columns = [whole(a) for a in (some.column("query_id"), sizes, terms.flatten(), weights.flatten())]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.nulls(1, c.type) for c in columns)], names=names)
                number, lo = number + 1, hi

    return run


class Lists:
    """The lists of one shard; those that hold a good part of its documents also as rows of a table."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], "<i8")
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.size, self.ends = counts, np.cumsum(counts)
        self.starts = self.ends - counts
        self.docs, self.weights = np.frombuffer(row["docs"], "<u4").astype(np.int64), np.frombuffer(row["weights"], np.float64)
        self.most = np.maximum.reduceat(self.weights, self.starts) if len(counts) else np.zeros(0)
        # Lists one after the other, each by document, so this is sorted.
        self.key = np.repeat(np.arange(len(counts)), counts) * len(self.ids) + self.docs
        full = np.flatnonzero(counts * THIN >= len(self.ids))
        self.row = np.full(len(counts), -1)
        self.row[full] = np.arange(len(full))
        self.single = self.weights.astype(np.float32)
        self.table = np.zeros((len(full), len(self.ids)), np.float32)
        entry = _spans(self.starts[full], counts[full])
        self.table[np.repeat(np.arange(len(full)), counts[full]), self.docs[entry]] = self.single[entry]

    def best(
        self, q: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int, k: int, floor: np.ndarray | float = 0.0
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(question, document, score, list entries read): the k best of each of n questions, whose words q[i], by
        question, has at place[i] with weight[i]. What scores less than a question's ``floor`` may be left out.

        Sums in single precision, with all that its rounding can amount to on the safe side, tell which documents may
        be among the best. Only their scores are then taken exactly.
        """
        width = len(self.ids)
        words = np.bincount(q, minlength=n)
        # Of unit vectors: each product, and each sum of them, is off by a share of 2^-24, and the sum is 1 at most.
        off = (words + 8) * 2.0**-23
        room = ROOM + off
        least, read, row, single = np.zeros(n) + floor, 0, self.row[place], weight.astype(np.float32)
        # Words that many of the questions have: one product.
        asked = np.bincount(row[row >= 0], minlength=len(self.table))
        often = (asked * OFTEN >= n) & (asked >= 8)
        product = np.append(often, False)[row]
        share = np.zeros((n, int(often.sum())), np.float32)
        share[q[product], (np.cumsum(often) - 1)[row[product]]] = single[product]
        total = share @ self.table[often]
        read += int(self.size[place[product]].sum())
        # Short lists, entry by entry.
        for some in _pieces(np.flatnonzero(row < 0), self.size[place]):
            each = self.size[place[some]]
            entry = _spans(self.starts[place[some]], each)
            np.add.at(total.reshape(-1), np.repeat(q[some] * width, each) + self.docs[entry], np.repeat(single[some], each) * self.single[entry])
            read += len(entry)
        # The other rows of the table only for questions that they can lift more than a few documents of.
        late = np.flatnonzero((row >= 0) & ~product)
        first, last = (np.searchsorted(q[late], np.arange(n), side=side) for side in ("left", "right"))
        left = np.bincount(q[late], weight[late] * self.most[place[late]], n)

        def near(rows: np.ndarray) -> np.ndarray:
            cut = np.where(left[rows] > 0, least[rows] - room[rows] - left[rows], np.maximum(least[rows] - room[rows], TINY))
            return total[rows] >= cut.astype(np.float32)[:, None]

        def raised(rows: np.ndarray) -> None:
            if width >= k and len(rows):
                least[rows] = np.maximum(least[rows], np.partition(total[rows], width - k, axis=1)[:, width - k] - off[rows])

        few, every = width // FEW, slice(None)
        found = near(every)
        over = np.count_nonzero(found, axis=1)
        fresh = np.flatnonzero((left > 0) & (least <= 0) & (over > few))
        raised(fresh)
        over[fresh] = np.count_nonzero(near(fresh), axis=1)
        whole = np.flatnonzero((left > 0) & (over > few))
        for i in whole:
            some = late[first[i] : last[i]]
            total[i] += single[some] @ self.table[row[some]]
        read += int(self.size[place[late[np.isin(q[late], whole)]]].sum())
        left[whole] = 0
        anew = np.union1d(fresh, whole)
        found[anew] = near(anew)
        many = np.flatnonzero((left == 0) & (np.count_nonzero(found, axis=1) > k))
        raised(many)
        found[many] = near(many)
        of, doc = np.divmod(np.flatnonzero(found), width)
        # What the table adds to documents looked up singly; most then are not among the best.
        sums = total[of, doc].astype(np.float64)
        open_ = np.flatnonzero(left[of] > 0)
        for some in _pieces(open_, (last - first)[of]):
            each = (last - first)[of[some]]
            word, at = late[_spans(first[of[some]], each)], np.repeat(np.arange(len(some)), each)
            sums[some] += np.bincount(at, self.table[row[word], doc[some][at]] * weight[word], len(some))
        kept = np.flatnonzero(sums >= (least - room)[of])
        of, doc = of[kept], doc[kept]
        score, first = np.zeros(len(of)), np.cumsum(words) - words
        for some in _pieces(np.arange(len(of)), words[of]):
            word, at = _spans(first[of[some]], words[of[some]]), np.repeat(np.arange(len(some)), words[of[some]])
            want = place[word] * width + doc[some][at]
            order = np.argsort(want)  # much faster to look up
            slot = np.empty(len(want), np.int64)
            slot[order] = np.minimum(np.searchsorted(self.key, want[order]), len(self.key) - 1)
            score[some] = np.bincount(at, np.where(self.key[slot] == want, self.weights[slot] * weight[word], 0.0), len(some))
        score = score.round(DIGITS)
        order = np.lexsort((self.ids[doc], -score, of))
        order = order[score[order] > 0]
        order = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < k]
        return of[order], doc[order], score[order], read


class Block:
    """Questions of one block, with their k best documents so far."""

    def __init__(self, row: dict, k: int) -> None:
        # Copies, so that no batch is held.
        self.ids = row["query_ids"].take(pa.array(np.arange(len(row["query_ids"]))))
        words = row["words"].dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.shares = row["shares"].to_numpy().copy()
        self.q = np.repeat(np.arange(len(self.ids)), row["sizes"].to_numpy())
        self.k, self.doc, self.score = k, np.zeros((len(self.ids), k), np.int64), np.zeros((len(self.ids), k))

    def meet(self, terms: pa.Array, lists: Lists) -> None:
        place = pc.index_in(self.words, value_set=terms).fill_null(-1).to_numpy()
        # Of the questions only those that may find something here.
        reach = np.bincount(self.q, self.shares * np.append(lists.most, 0.0)[place][self.word], len(self.ids))
        live = (reach > 0) & (reach >= self.score[:, -1] - ROOM)
        some = np.flatnonzero((live[self.q]) & (place >= 0)[self.word])
        rows, q, place, shares = np.flatnonzero(live), (np.cumsum(live) - 1)[self.q[some]], place[self.word[some]], self.shares[some]
        step = max(1, CELLS // max(1, len(lists.ids)))
        for lo in range(0, len(rows), step):
            i, j = np.searchsorted(q, [lo, lo + step])
            mine = rows[lo : lo + step]
            of, doc, score, _ = lists.best(q[i:j] - lo, place[i:j], shares[i:j], len(mine), self.k, self.score[mine, -1])
            self.add(mine[of], lists.ids[doc], score)

    def add(self, of: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Takes in at most k documents of each question, which come by question."""
        rows, first, each = np.unique(of, return_index=True, return_counts=True)
        docs, scores = (np.hstack([a[rows], np.zeros((len(rows), self.k), a.dtype)]) for a in (self.doc, self.score))
        at = np.repeat(np.arange(len(rows)), each), self.k + np.arange(len(of)) - np.repeat(first, each)
        docs[at], scores[at] = doc, score
        order = np.lexsort((docs, -scores), axis=1)[:, : self.k]
        self.doc[rows], self.score[rows] = np.take_along_axis(docs, order, 1), np.take_along_axis(scores, order, 1)


def _answers(k: int):
    """The k best documents of each question among the shards its block meets in this task. A block comes with the
    first shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = {}
        held, lists = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, number = batch.column("shard")[i].as_py(), batch.column("block")[i].as_py()
                terms = batch.column("terms")[i].values
                if shard != held:
                    held, lists = shard, Lists({c: batch.column(c)[i].as_py() for c in ("ids", "counts", "docs", "weights")})
                if number not in blocks:
                    blocks[number] = Block({c: batch.column(c)[i].values for c in ("query_ids", "sizes", "words", "shares")}, k)
                blocks[number].meet(terms, lists)
        for block in blocks.values():
            of, at = np.nonzero(block.score > 0)
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(of)), pa.array(block.doc[of, at]), pa.array(block.score[of, at])], names=["query_id", "doc_id", "score"])

    return run


def build(corpus: DataFrame, doc_id: str, text_col: str, folder: str) -> tuple[DataFrame, DataFrame, int] | None:
    """(index, idf, bytes of lists), written to ``folder``; None where no document has a word."""
    spark = corpus.sparkSession
    texts = spread(corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    texts.select("doc_id", words_of(F.col("text")).alias("words")).mapInArrow(_shards(SHARD_WORDS), SHARD).write.parquet(f"{folder}/shards")
    shards = spark.read.schema(SHARD).parquet(f"{folder}/shards")
    facts = shards.agg(F.sum(F.octet_length("docs").cast("long")).alias("bytes"), F.sum(F.octet_length("ids").cast("long") / 8).alias("n"), F.count("*").alias("shards")).first()
    if not facts["bytes"]:
        return None
    held = shards.select("shard", "terms", "counts").mapInArrow(_frequencies, "shard long, place int, term string, df long")
    held.write.parquet(f"{folder}/words")
    held = spark.read.schema("shard long, place int, term string, df long").parquet(f"{folder}/words")
    idf = held.groupBy("term").agg((F.log((F.lit(1.0) + facts["n"]) / (F.sum("df") + 1.0)) + 1.0).alias("idf"))
    idf.write.parquet(f"{folder}/idf")
    idf = spark.read.schema("term string, idf double").parquet(f"{folder}/idf")
    per_shard = held.join(idf, "term").groupBy("shard").agg(F.collect_list(F.struct("place", "idf")).alias("idf"))
    shards.join(per_shard, "shard").select("shard", "ids", "terms", "counts", "docs", "tfs", "idf").mapInArrow(_weighed, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index"), idf, 3 * facts["bytes"]


def nearest_terms(
    questions: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, k: int = NEIGHBOURS, text_col: str = "text"
) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents by unit-norm TF-IDF product, exactly.

    No vocabulary limit: rare words find what holds them. Null and empty texts
    have no words; ties go to the smaller id; scores are rounded before ranking.
    Questions and documents have unique ids.
    """
    spark = corpus.sparkSession
    folder = run_dir(spark, "postings")
    id_type = questions.schema[query_id].dataType.simpleString()
    result = f"query_id {id_type}, doc_id long, score double"
    built = build(corpus, doc_id, text_col, folder)
    if built is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, doc_id long, score double")
    index, idf, size = built
    each = questions.select(F.col(query_id).alias("query_id"), F.explode(words_of(F.col(text_col))).alias("term"))
    weighed = each.groupBy("query_id", "term").agg(F.count("*").alias("tf")).join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    listed = weighed.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    vector = listed.select("query_id", F.col("t.term").alias("terms"), F.transform("t.w", lambda w: w / F.col("norm")).alias("weights"))
    # Every block meets every shard. The product reads both where they are; a block's questions come to a task once, with
    # the first shard, and are only named with the others.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(ceil(questions.count() / BLOCK), 1)
    parts = max(ceil(size / GROUP_BYTES), ceil(tasks / blocks))
    packed = f"block long, query_ids array<{id_type}>, sizes array<int>, words array<string>, shares array<double>"
    right = vector.repartition(blocks, "query_id").mapInArrow(_blocks(BLOCK, BLOCK_WORDS), packed)
    opens = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    left = index.coalesce(parts).withColumn("opens", opens)
    pairs = left.hint("shuffle_replicate_nl").join(right, F.col("opens") != F.col("query_ids").isNull())
    pairs.mapInArrow(_answers(k), result).write.parquet(f"{folder}/hits")
    return ranked(spark.read.schema(result).parquet(f"{folder}/hits"), k, True)
