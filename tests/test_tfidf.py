import dataclasses
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinionlake.functions import text as TX
from opinionlake.operators import tfidf as T
from opinionlake.plans import pipeline
from opinionlake.profiles import ALADIN, KYOBO, YES24

TEXTS = [
    "Book book 책 좋은 내용 좋은 내용", "책. 책 좋아요! 좋아요 배송 빠른 배송", "빠른 배송 좋은 내용 good book",
    "good good book a b", "하나", "", "good book good book 좋은", "zz yy xx zz yy",
]


def tokens(text, p):
    text = text.lower() if p.lowercase else text
    return [t for t in text.split() if len(t) >= 2 and t not in p.stopwords]


def by_hand(texts, p):
    """Straight definition, row by row."""
    rows = []
    for text in texts:
        k = tokens(text, p)
        rows.append(Counter(k + ([f"{a} {b}" for a, b in zip(k, k[1:])] if p.bigrams else [])))
    df, ctf = Counter(), Counter()
    for row in rows:
        df.update(row.keys())
        ctf.update(row)
    kept = sorted((t for t in df if df[t] >= p.min_df), key=lambda t: (-ctf[t], t))[: p.max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, row in enumerate(rows):
        w = {t: n * idf[t] for t, n in row.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): round(v / norm, 9) for t, v in w.items()})
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "review_seq long, content_clean string")


@pytest.mark.parametrize("profile", [ALADIN, KYOBO, YES24, dataclasses.replace(ALADIN, max_features=5)])
def test_equals_definition(spark, profile):
    got = T.tfidf(frame(spark, TEXTS), profile).collect()
    assert {(r.review_seq, r.term): round(r.tfidf, 9) for r in got} == by_hand(TEXTS, profile)


def test_case_and_stopwords(spark):
    terms = {r.term for r in T.tfidf(frame(spark, TEXTS), ALADIN).collect()}
    assert {"Book", "book", "Book book"} <= terms
    terms = {r.term for r in T.tfidf(frame(spark, TEXTS), YES24).collect()}
    assert "배송" not in terms and "좋은 내용" in terms


def test_stopword_with_punctuation_stays(spark):
    got = frame(spark, ["책. 너무 너무. 좋아요! 좋아요"]).select(TX.tokens(F.col("content_clean"), YES24)).first()[0]
    assert got == ["책.", "너무.", "좋아요!"]


def test_own_tokenizer(spark):
    commas = dataclasses.replace(KYOBO, tokenizer=lambda c: F.split(c, ","), min_df=1)
    got = {r.term for r in T.tfidf(frame(spark, ["A b,c", "c"]), commas).collect()}
    assert got == {"a b", "c"}


def test_word_rule_on_text_with_marks(spark):
    marked = dataclasses.replace(KYOBO, marks=".!")
    got = frame(spark, ["Good. book! a b2"]).select(TX.tokens(F.col("content_clean"), marked)).first()[0]
    assert got == ["good", "book", "b2"]


def test_sites_are_fitted_apart(spark):
    both = frame(spark, TEXTS).withColumn("site", F.lit("aladin")).unionByName(
        frame(spark, TEXTS).withColumn("site", F.lit("yes24")).withColumn("review_seq", F.col("review_seq") + 100)
    )
    got = {(r.site, r.review_seq, r.term): round(r.tfidf, 9) for r in T.tfidf(both, (ALADIN, YES24)).collect()}
    expected = {("aladin", i, t): w for (i, t), w in by_hand(TEXTS, ALADIN).items()}
    expected |= {("yes24", i + 100, t): w for (i, t), w in by_hand(TEXTS, YES24).items()}
    assert got == expected


def test_rows_without_terms_keep_zeros(spark):
    rows = T.tfidf_rows(frame(spark, TEXTS), KYOBO).withColumns(T.row_sums()).collect()
    got = {r.review_seq: (r.tfidf_sum, r.tfidf_nonzero_cnt) for r in rows}
    assert len(got) == len(TEXTS) and got[4] == (0.0, 0) and got[5] == (0.0, 0)


def test_empty_vocabulary_is_no_error(spark):
    rows = T.tfidf_rows(frame(spark, ["a b", "c"]), YES24).collect()
    assert [r.terms for r in rows] == [[], []]
    assert T.tfidf_rows(frame(spark, []), YES24).count() == 0


def test_one_exchange_feeds_both_passes(spark, tmp_path):
    df = T.tfidf(frame(spark, TEXTS * 50).withColumn("review_seq", F.monotonically_increasing_id()), ALADIN)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or "Reused" in plan


def test_term_means_count_zero_rows(spark):
    expected = Counter()
    for (_, t), w in by_hand(TEXTS, ALADIN).items():
        expected[t] += w / len(TEXTS)
    got = {r.term: r.mean_tfidf for r in T.term_means(T.tfidf_rows(frame(spark, TEXTS), ALADIN)).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[t] - expected[t]) < 1e-8 for t in got)
    top = [r.term for r in T.top_terms(T.tfidf_rows(frame(spark, TEXTS), ALADIN), 3).collect()]
    assert top == sorted(expected, key=lambda t: (-round(expected[t], 6), t))[:3]


def test_bigrams_of_short_lists(spark):
    got = spark.createDataFrame([(["a"],), ([],), (["a", "b", "a"],)], "w array<string>").select(
        TX.with_bigrams(F.col("w")).alias("g")
    )
    assert [r.g for r in got.collect()] == [["a"], [], ["a", "b", "a", "a b", "b a"]]


def names_of(spark, keys):
    from opinionlake.functions.values import safe_key
    from opinionlake.operators.keyed import unique_names

    df = spark.createDataFrame([(keys,)], "k array<string>")
    got = df.select(unique_names(F.col("k"), F.transform("k", safe_key)).alias("n")).first().n
    return {r.key: r.name for r in got}


def test_colliding_names_get_suffixes(spark):
    assert names_of(spark, ["a b", "a$b", "a.b", "a_b"]) == {"a b": "a_b", "a$b": "a_b_2", "a.b": "a_b_3", "a_b": "a_b_4"}
    # A natural name equal to a suffixed one moves on to its own next suffix.
    assert names_of(spark, ["x", "x.", "x_2"]) == {"x": "x", "x.": "x_2", "x_2": "x_2_2"}
    assert names_of(spark, ["x", "x_2", "x_"]) == {"x": "x", "x_2": "x_2", "x_": "x_3"}
    assert names_of(spark, []) == {}


def test_maps_hold_every_weight(spark):
    texts = ["a1. a1 b2", "a1. c3", "a1 b2"]
    maps = {r.review_seq: r.tfidf for r in pipeline.tfidf_maps(frame(spark, texts), ALADIN).collect()}
    long = by_hand(texts, ALADIN)
    assert {i: len(m) for i, m in maps.items()} == {i: sum(k[0] == i for k in long) for i in range(3)}
    # "a1. a1" loses its dot and its blank to one underscore each.
    assert set(maps[0]) == {"a1", "a1_2", "b2", "a1__a1", "a1_b2"}


def test_terms_that_are_not_kept_never_become_rows(spark):
    """Weights are made from a row's token list at once: no list is exploded, and nothing is grouped by row."""
    plan = T.tfidf_rows(frame(spark, TEXTS), YES24)._jdf.queryExecution().analyzed().toString().split("scalar-subquery")[0]
    assert "Generate" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]


def test_slices_hold_whole_rows_and_every_term(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "SLICE", 3)
    words = [["a1", "b2"], None, [], ["c3", "d4", "e5", "f6"], ["a1"], ["b2", "b2"]]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "x", "x", "y", "x"]), pa.array(words, pa.list_(pa.string()))], names=["site", "_words"])
    got, slices = [], 0
    for site, rows, of, terms in T._slices(batch, {"x"}):
        slices += 1
        got += [(site, rows[i].item(), t) for i, t in zip(of, terms.to_pylist(), strict=True)]
    assert slices > 2
    every = {0: ["a1", "b2", "a1 b2"], 3: ["c3", "d4", "e5", "f6", "c3 d4", "d4 e5", "e5 f6"], 5: ["b2", "b2", "b2 b2"]}
    assert sorted(got) == sorted([("x", r, t) for r, ts in every.items() for t in ts] + [("y", 4, "a1")])
