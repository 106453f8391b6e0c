import datetime as dt

import pytest
from pyspark.sql import functions as F

from opinionlake.functions import text as TX
from opinionlake.functions import values as V
from opinionlake.operators import cleaning as C
from opinionlake.operators.keyed import with_processed_id
from opinionlake.profiles import ALADIN, KYOBO, PROFILES, YES24
from opinionlake.sources import files

AS_OF = dt.datetime(2024, 6, 1, 12, 0)


def rows_of(spark, rows):
    schema = "review_seq long, site string, rating string, date string, content string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def one(spark, value, build):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(build(F.col("v")).alias("r")).first()["r"]


def test_csv_multiline_bom_and_na(spark, tmp_path):
    path = tmp_path / "reviews_yes24.csv"
    path.write_text('﻿rating,date,content\n5,2024-01-02,"줄1\n줄2 ""q"""\nNA,None,\n', encoding="utf-8")
    got = [tuple(r) for r in files.read_reviews(spark, str(path)).collect()]
    assert got == [("5", "2024-01-02", '줄1\n줄2 "q"'), (None, None, None)]


def test_read_all_skips_unknown_sites_and_aligns_columns(spark, tmp_path):
    (tmp_path / "reviews_kyobo.csv").write_text("date,content,rating\n2024-01-01,좋은 책,9.5\n", encoding="utf-8")
    (tmp_path / "reviews_aladin.csv").write_text("rating,date,content\n4,2024-01-03,재미있어요\n", encoding="utf-8")
    (tmp_path / "reviews_other.csv").write_text("rating,date,content\n1,2024-01-03,x\n", encoding="utf-8")
    got = {(r.site, r.rating, r.date, r.content) for r in files.read_all(spark, str(tmp_path)).collect()}
    assert got == {("kyobo", "9.5", "2024-01-01", "좋은 책"), ("aladin", "4", "2024-01-03", "재미있어요")}


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="content"):
        C.require_columns(spark.createDataFrame([("5", "d")], "rating string, date string"))


@pytest.mark.parametrize(
    "raw, number",
    [("5", 5.0), (" 5 ", 5.0), ("9.5", 9.5), ("1e1", 10.0), ("5점", None), ("NaN", None), ("5d", None), ("", None)],
)
def test_rating_coercion(spark, raw, number):
    assert one(spark, raw, V.to_number) == number


def test_date_coercion(spark):
    assert one(spark, "2024-01-02", V.to_moment) == dt.datetime(2024, 1, 2)
    assert one(spark, "2024-01-02 10:30:00", V.to_moment) == dt.datetime(2024, 1, 2, 10, 30)
    assert one(spark, "bad", V.to_moment) is None
    assert one(spark, "2024-13-02", V.to_moment) is None


def test_range_bounds_are_inclusive_per_site(spark):
    ratings = ["0", "1", "5", "5.5", "10", "10.5"]
    rows = rows_of(spark, [(s, r, "2024-01-01", "긴 리뷰 본문 " + s + r) for s in PROFILES for r in ratings])
    kept = C.preprocess_all(rows, AS_OF).groupBy("site").agg(F.sort_array(F.collect_list("rating")).alias("r"))
    got = {r.site: r.r for r in kept.collect()}
    # yes24's length quantile drops nothing here: all lengths are close.
    assert got["aladin"] == [1.0, 5.0] and got["kyobo"] == [0.0, 1.0, 5.0, 5.5, 10.0]


def test_cutoff_midnight_and_instant(spark):
    dates = ["2024-06-01", "2024-06-01 10:00:00", "2024-06-01 13:00:00", "2024-06-02"]
    for profile, expected in ((ALADIN, 1), (KYOBO, 2)):
        rows = rows_of(spark, [(profile.site, "5", d, f"본문 내용 {i} 입니다") for i, d in enumerate(dates)])
        assert C.preprocess(rows, profile, AS_OF).count() == expected


@pytest.mark.parametrize(
    "profile, text, expected",
    [
        (ALADIN, "최고예요!! (강추) 😀ㅋㅋㅋ", "최고예요!! (강추)"),
        (KYOBO, "최고예요!! (강추) 😀ㅋㅋㅋ", "최고예요 강추"),
        (YES24, "글쎄… (강추) 좋다.", "글쎄… 강추 좋다."),
        (YES24, "a 　b\t\nc", "a b c"),
        (KYOBO, "😀😀", ""),
        (ALADIN, "a/b [c] \"d\" 'e' f-g; h: i", "a/b [c] \"d\" 'e' f-g; h: i"),
    ],
)
def test_cleaning_keeps_each_shops_characters(spark, profile, text, expected):
    assert one(spark, text, lambda c: TX.clean_text(c, profile)) == expected


def test_length_rules(spark):
    rows = rows_of(spark, [(s, "5", "2024-01-01", t) for s in ("aladin", "yes24") for t in ("!!!!", "abcd", "abcde")])
    assert [r.content_clean for r in C.preprocess(rows, ALADIN, AS_OF).collect()] == ["abcde"]
    texts = ["한단어", "두 단어", "가 " * 1500 + "나", "가 " * 1499 + "나"]
    rows = rows_of(spark, [("kyobo", "5", "2024-01-01", t) for t in texts])
    got = sorted(r.content_len for r in C.preprocess(rows, KYOBO, AS_OF).collect())
    assert got == [4, 2999]


def test_quantile_edge_is_inclusive(spark):
    rows = rows_of(spark, [("yes24", "5", "2024-01-01", "x" * n) for n in range(5, 105)])
    # 99th of 5..104 lies at 103.01: only the longest goes.
    got = C.preprocess(rows, YES24, AS_OF).agg(F.max("content_len"), F.count("*")).first()
    assert tuple(got) == (103, 99)


def test_dedupe_keeps_first_of_equal_cleaned_text(spark):
    rows = rows_of(spark, [
        ("kyobo", "9", "2024-01-01", "좋은 책!"), ("kyobo", "9.0", "2024-01-01", "좋은   책"),
        ("kyobo", "9", "2024-01-02", "좋은 책!"), ("kyobo", "8", "2024-01-01", "좋은 책!"),
    ])
    assert sorted(r.review_seq for r in C.preprocess(rows, KYOBO, AS_OF).collect()) == [0, 2, 3]


def test_dedupe_takes_a_date_as_its_day(spark):
    """A review listed with a time and without is one; the first row stays, as it would by ``processed_id``."""
    rows = rows_of(spark, [
        ("kyobo", "9", "2024-01-01 09:30", "좋은 책"), ("kyobo", "9", "2024-01-01", "좋은 책"),
        ("kyobo", "9", "2024-01-01T00:00:00.5Z", "좋은 책!"), ("kyobo", "9", "2024-01-02 09:30", "좋은 책"),
    ])
    kept = C.preprocess(rows, KYOBO, AS_OF)
    assert sorted(r.review_seq for r in kept.collect()) == [0, 3]
    assert with_processed_id(kept).select("processed_id").distinct().count() == 2
    report = C.filter_report(rows, AS_OF).where("site = 'kyobo'").first()
    assert (report.rows_unique, report.rows_kept) == (2, 2)


def test_row_order_does_not_matter(spark):
    rows = rows_of(spark, [("kyobo", "9", "2024-01-01", f"같은 책 {i % 3}") for i in range(30)])
    a = C.preprocess(rows, KYOBO, AS_OF).collect()
    b = C.preprocess(rows.orderBy(F.desc("review_seq")), KYOBO, AS_OF).collect()
    assert sorted(a) == sorted(b) and len(a) == 3


def test_hot_copies_reach_the_reducer_limited(spark):
    plan = C.preprocess(rows_of(spark, []), KYOBO, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_empty_input_keeps_schema(spark, tmp_path):
    out = C.preprocess_all(rows_of(spark, []), AS_OF)
    files.save(out, str(tmp_path / "t"))
    back = spark.read.schema(out.schema).parquet(str(tmp_path / "t"))
    assert back.count() == 0 and "content_clean" in back.columns


def test_save_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb')], "id int, t string")
    files.save(df, str(tmp_path / "c"), fmt="csv")
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "c")).first()
    assert (back.id, back.t) == ("1", 'a "q"\nb')


def test_nbsp_tail_words_and_fallback(spark):
    assert one(spark, " a b ", TX.fix_nbsp) == "a b"
    assert one(spark, "좋은  책 + 더보기 ", TX.strip_tail) == "좋은 책"
    assert one(spark, "+ 더보기 가 아니다", TX.strip_tail) == "+ 더보기 가 아니다"
    assert one(spark, "", TX.word_len) == 0 and one(spark, "a b c", TX.word_len) == 3
    assert one(spark, "", lambda c: TX.first_text(c, F.lit("x"), F.lit("y"))) == "x"


def test_weekday_and_weekend(spark):
    got = spark.createDataFrame([(dt.date(2024, 1, 6),)], "d date").select(
        *[c.alias(n) for n, c in V.date_parts(F.col("d")).items()]
    ).first()
    assert tuple(got) == (2024, 1, 5, "Sat", 1, "2024-01")


def test_safe_key(spark):
    cases = {"a.b": "a_b", "a$b": "a_b", "a b": "a_b", "_a_": "a", "": "_", "..": "_", "x\u0000y": "xy"}
    for raw, safe in cases.items():
        assert one(spark, raw, V.safe_key) == safe


def test_emails(spark):
    for good in ("test@example.com", "a.b+c@x-y.co.kr"):
        assert one(spark, good, V.valid_email)
    for bad in ("testexample.com", "a@b", "@x.com", "a b@x.com", None):
        assert not one(spark, bad, V.valid_email)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-02 10:30", dt.datetime(2024, 1, 2, 10, 30)), ("2024-01-02T10:30:00Z", dt.datetime(2024, 1, 2, 10, 30)),
        ("2024-01-02 10:30:00.5", dt.datetime(2024, 1, 2, 10, 30, 0, 500000)), ("2024-1-2", dt.datetime(2024, 1, 2)),
        ("20240102", dt.datetime(2024, 1, 2)), ("2024-01-02T10:30+09:00", dt.datetime(2024, 1, 2, 1, 30)),
        ("2024.1.2 3:04", dt.datetime(2024, 1, 2, 3, 4)), ("2024-01-02T10:30:00,25-0130", dt.datetime(2024, 1, 2, 12, 0, 0, 250000)),
        ("2024-01-02 10:30+01", dt.datetime(2024, 1, 2, 9, 30)), ("2024-1.2", None), ("20241302", None), ("2024-02-30", None),
        ("202401", None), ("2024-01-02 25:00", None), ("2024-01-02 10:30 tail", None), ("", None),
    ],
)
def test_spellings_of_dates(spark, text, want):
    assert one(spark, text, V.to_moment) == want
