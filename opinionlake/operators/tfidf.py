"""TF-IDF as long tables, for one site or all sites in one job.

Plan: the cleaned text is partitioned once by row id. Both passes read that
one exchange. Tokens are made by built-in functions; Arrow batches of token
lists then go to numpy, where bigrams are joined and counted. The first pass
hands on one row per distinct term of a slice of rows, grouped on (site, term)
with a combine before the shuffle. The kept vocabulary (at most
``max_features`` rows per profile) is a scalar, carried by the first row of
each partition of the second pass, which looks terms up in it and weighs a
row at once. Terms that are not kept so never become rows, and counts per row,
norms and output rows need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.functions.text import tokens
from opinionlake.operators.cleaning import per_site
from opinionlake.operators.ranking import head_per
from opinionlake.profiles import Profile

# Marks "one row": its document frequency is the number of fitted rows, so
# they are counted in the same pass. Tokens have two characters or more.
ROW = ""
# Tokens that are counted at once.
SLICE = 1 << 20
# Rows of a partition are numbered from a multiple of this.
NUMBERED = 1 << 33

Profiles = Profile | Sequence[Profile]


def several(profiles: Profiles) -> tuple[Profile, ...]:
    return (profiles,) if isinstance(profiles, Profile) else tuple(profiles)


def sited(df: DataFrame, profiles: Profiles) -> DataFrame:
    """Rows with a ``site``: their own, or the one profile's."""
    return df if "site" in df.columns else df.withColumn("site", F.lit(several(profiles)[0].site))


def listed_words(rows: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "content_clean") -> DataFrame:
    """(keep..., site, _words): each row's tokens under its site's rule; NULL for other sites."""
    words = per_site({p.site: tokens(F.col(text_col), p) for p in several(profiles)})
    return rows.select(*keep, "site", words.alias("_words"))


def _slices(batch: pa.RecordBatch, paired: set[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    """(site, rows, of, terms): rows of one site with tokens, some at a time; term i, a token or a neighbouring pair
    joined by a blank, is of row ``rows[of[i]]``."""
    sites, words = batch.column("site"), batch.column("_words")
    for site in pc.unique(sites).drop_null().to_pylist():
        mine = pc.and_(pc.fill_null(pc.equal(sites, site), False), words.is_valid())
        every = np.flatnonzero(mine.to_numpy(zero_copy_only=False))
        n = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[every]
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // SLICE)) + 1
        for rows in np.split(every, cuts) if len(every) else ():
            some = words.take(pa.array(rows))
            terms = some.flatten()
            of = np.repeat(np.arange(len(rows)), some.value_lengths().to_numpy())
            if site in paired:
                left = pa.array(np.flatnonzero(of[1:] == of[:-1]))
                pairs = pc.binary_join_element_wise(terms.take(left), terms.take(pc.add(left, 1)), " ")
                terms, of = pa.concat_arrays([terms, pairs]), np.append(of, of[left.to_numpy()])
            if terms.null_count:
                of, terms = of[terms.is_valid().to_numpy(zero_copy_only=False)], terms.drop_null()
            yield site, rows, of, terms


def partition_rows(df: DataFrame, id_col: str) -> DataFrame:
    """Rows spread by their unique id, so evenly whatever the sites hold.

    The partition count is the session's own: exploded terms outweigh the
    text, so it is not left to be coalesced by text size.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Joins on the id would add this filter to one reader of the exchange and
    # so part the two; ids are never NULL.
    return df.where(F.col(id_col).isNotNull()).repartition(partitions, id_col)


def term_stats(rows: DataFrame, profiles: Profiles, text_col: str = "content_clean") -> DataFrame:
    """(site, term, df, ctf): rows holding a term and its count over all rows."""
    paired = {p.site for p in several(profiles) if p.bigrams}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for site, some, of, terms in _slices(batch, paired):
                coded = terms.dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                ctf = np.bincount(code, minlength=len(coded.dictionary))
                held = np.sort(code * len(some) + of)
                held = held[np.append(True, held[1:] != held[:-1])] if len(held) else held
                df = np.bincount(held // len(some), minlength=len(coded.dictionary))
                count = lambda n: pa.array(np.append(n, len(some)), pa.int64())
                names = pa.concat_arrays([coded.dictionary, pa.array([ROW], coded.dictionary.type)])
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(site, len(names)), names, count(df), count(ctf)], names=["site", "term", "df", "ctf"]
                )

    counted = listed_words(sited(rows, profiles), profiles, [], text_col).mapInArrow(
        run, "site string, term string, df long, ctf long"
    )
    return counted.groupBy("site", "term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def vocabulary(stats: DataFrame, profiles: Profiles) -> DataFrame:
    """Kept terms per site with idf: the ``max_features`` most frequent after
    ``min_df``, ties by term. Holds the ROW mark with idf 0 as well, at slot
    0; terms take slots 1, 2, ... in order."""
    profiles = several(profiles)
    is_row = F.col("term") == ROW
    ordered = stats.where(is_row | per_site({p.site: F.col("df") >= p.min_df for p in profiles})).withColumns(
        {"_row": is_row, "_less": -F.col("ctf")}
    )
    kept = head_per(ordered, ["site", "_row"], ["_less", "term"], max(p.max_features for p in profiles))
    kept = kept.where(per_site({p.site: F.col("position") <= p.max_features for p in profiles}))
    # At most max_features + 1 rows per site reach these windows.
    site = Window.partitionBy("site")
    n = F.max(F.when(is_row, F.col("df"))).over(site)
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1
    return kept.select(
        "site", "term", "df", "ctf",
        F.when(is_row, 0.0).otherwise(idf).alias("idf"),
        (F.row_number().over(site.orderBy("term")) - 1).alias("slot"),
    )


def real_terms(df: DataFrame) -> DataFrame:
    return df.where(F.col("term") != ROW)


def fit(df: DataFrame, profiles: Profiles, text_col: str = "content_clean") -> DataFrame:
    """Vocabulary of a table of cleaned rows."""
    return vocabulary(term_stats(df, profiles, text_col), profiles)


def weigh(rows: DataFrame, vocab: DataFrame, profiles: Profiles, id_col: str, text_col: str = "content_clean") -> DataFrame:
    """One row per input row: its kept terms with unit-norm weights, by slot.

    Rows without a kept term have an empty list. The vocabulary is bounded by
    ``max_features`` per profile; where it has a ``name``, terms have it too.
    """
    rows = sited(rows, profiles)
    paired = {p.site for p in several(profiles) if p.bigrams}
    fields = [f for f in ("term", "slot", "name") if f in vocab.columns]
    whole = real_terms(vocab).agg(F.collect_list(F.struct("site", "idf", *fields))).scalar()
    first = F.monotonically_increasing_id() % NUMBERED == 0
    listed = listed_words(rows, profiles, [id_col], text_col).select(id_col, "site", "_words", F.when(first, whole).alias("_vocab"))
    kinds = [T.StructField(f, vocab.schema[f].dataType) for f in fields]
    made = T.StructType([
        T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("site", T.StringType()),
        T.StructField("terms", T.ArrayType(T.StructType([*kinds, T.StructField("tfidf", T.DoubleType())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: pa.StructArray | None = None
        of_site: dict[str, tuple[pa.RecordBatch, np.ndarray]] = {}
        for batch in batches:
            if known is None and batch.num_rows:
                known = batch.column("_vocab")[0].values
                table = pa.RecordBatch.from_struct_array(known)
                for site in pc.unique(known.field("site")).to_pylist():
                    mine = table.filter(pc.equal(table.column("site"), site)).sort_by("slot")
                    of_site[site] = mine.select(fields), mine.column("idf").to_numpy()
            for site, some, of, terms in _slices(batch, paired):
                vocabulary, idf = of_site.get(site) or (table.select(fields).slice(0, 0), np.zeros(0))
                at = pc.index_in(terms, value_set=vocabulary.column("term")).fill_null(-1).to_numpy().astype(np.int64)
                hit = at >= 0
                held, tf = np.unique(of[hit] * max(len(idf), 1) + at[hit], return_counts=True)
                row, at = np.divmod(held, max(len(idf), 1))
                w = tf * idf[at]
                norm = np.sqrt(np.bincount(row, w * w, len(some)))
                ends = np.cumsum(np.bincount(row, minlength=len(some)))
                shown = [c.take(pa.array(at)) for c in vocabulary.columns]
                each = pa.StructArray.from_arrays([*shown, pa.array(w / norm[row])], names=[*fields, "tfidf"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), each)
                ids = batch.column(id_col).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.repeat(site, len(some)), lists], names=[id_col, "site", "terms"])

    return listed.mapInArrow(run, made)


def tfidf_rows(df: DataFrame, profiles: Profiles, id_col: str = "review_seq", text_col: str = "content_clean") -> DataFrame:
    """(id, site, terms array<struct<term, slot, tfidf>>), one row per input row.

    An empty vocabulary gives empty lists, never an error.
    """
    rows = partition_rows(sited(df, profiles).select(id_col, "site", text_col), id_col)
    return weigh(rows, fit(rows, profiles, text_col), profiles, id_col, text_col)


def tfidf(df: DataFrame, profiles: Profiles, id_col: str = "review_seq", text_col: str = "content_clean") -> DataFrame:
    """Long form (id, site, term, tfidf)."""
    return tfidf_rows(df, profiles, id_col, text_col).select(id_col, "site", F.inline("terms")).drop("slot")


def row_sums(terms_col: str = "terms") -> dict[str, Column]:
    """Sum and non-zero count of a row's weights."""
    return {
        "tfidf_sum": F.aggregate(terms_col, F.lit(0.0), lambda s, t: s + t["tfidf"]),
        "tfidf_nonzero_cnt": F.size(terms_col),
    }


def term_means(rows: DataFrame) -> DataFrame:
    """(site, term, mean_tfidf) over all rows of a site, zeros included.

    Takes ``tfidf_rows`` output. Each row adds one ROW mark of weight 1, so
    the row count comes with the sums; at most ``max_features`` + 1 rows per
    site reach the window.
    """
    mark = F.array(F.struct(F.lit(ROW).alias("term"), F.lit(0).alias("slot"), F.lit(1.0).alias("tfidf")))
    long = rows.select("site", F.inline_outer(F.concat(mark, "terms")))
    sums = long.groupBy("site", "term").agg(F.sum("tfidf").alias("total"))
    n = F.max(F.when(F.col("term") == ROW, F.col("total"))).over(Window.partitionBy("site"))
    means = real_terms(sums.withColumn("_n", n))
    return means.select("site", "term", (F.col("total") / F.col("_n")).alias("mean_tfidf"))


def top_terms(rows: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` terms per site with the highest mean weight, ties by term."""
    best = Window.partitionBy("site").orderBy(F.round("mean_tfidf", 6).desc(), "term")
    ranked = term_means(rows).withColumn("_rank", F.row_number().over(best))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
