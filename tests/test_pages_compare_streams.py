import datetime as dt
import html
import math

import pytest
from pyspark.sql import functions as F

from opinionlake import session
from opinionlake.functions import extract as X
from opinionlake.functions import text as TX
from opinionlake.functions import values as V
from opinionlake.operators import compare, keyed
from opinionlake.sources import pages as P
from opinionlake.streaming import ingest


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text", ["width: 95%", "width:100%", "", "width: 86.5%", "width: 64.5%", "width: 83.5%", "width: 2.5%", "width: 7.5%", "width: 0.3%"]
)
def test_rating_from_width_rounds_the_double(spark, text):
    given = text.replace("width:", "").replace("%", "").strip()
    assert one(spark, text, X.rating_from_width) == round(float(given or 0) / 10.0, 1)


def test_tenths_equal_python_rounding(spark):
    df = spark.range(0, 20_010).select((F.col("id") / 20).alias("p"), X.round_tenths(F.col("id") / 20 / 10).alias("r"))
    assert [r for r in df.collect() if r.r != round(r.p / 10, 1)] == []


def test_character_references(spark):
    text = "A &amp; B&nbsp;&#39;x&#x27; &lt;b&gt; &amp;lt; &hellip;&#44032;&#x1F600; &#99999999; &unknown; &#1114112;"
    want = "A & B\u00a0'x' <b> &lt; …가😀 \ufffd &unknown; \ufffd"
    assert one(spark, text, X.decode_entities) == want
    for text in ("caf&eacute; 5&euro; &szlig; &copy; &copy 2024 &AMP; &#38;lt; &#150; &#0; &#xD800; &#65 &#x00000000000041; &#99999999999999999999999;", "&CounterClockwiseContourIntegral;&bne;", "none & none;", "&amp;amp;amp;", "&&amp;&"):
        assert one(spark, text, X.decode_entities) == html.unescape(text)


def test_elements_inside_elements(spark):
    html = '<div class="a">one <div>two <DIV x="1"/></div> three<br/><div>four</div></div> rest <div>'
    assert one(spark, html, lambda c: P.element_text(c, 'class="a"', "</div>")) == "one two three four"
    assert one(spark, '<p class="a">open', lambda c: P.element_text(c, 'class="a"', "</p>")) == "open"
    assert one(spark, "none", lambda c: P.element_text(c, 'class="a"', "</p>")) is None


@pytest.mark.parametrize("text", ["2024-01-02", "2024.01.02", "2024/01/02", "\u00a02024-01-02 \n"])
def test_date_spellings(spark, text):
    assert one(spark, text, V.to_moment) == dt.datetime(2024, 1, 2)


def test_strip_takes_all_white_space(spark):
    assert one(spark, " \t\n\u00a0\u3000a b\u2003\x1c\r\n", V.strip) == "a b"


def test_plain_values_recurse(spark):
    kind = "struct<l:array<map<string,double>>,s:struct<t:timestamp,n:string>>"
    df = spark.sql("SELECT named_struct('l', array(map('a.b', double('NaN'), 'a b', 1.5D), null), 's', named_struct('t', timestamp'2024-01-02 03:04:05', 'n', null)) AS v")
    got = df.select(V.plain_value(F.col("v"), df.schema["v"].dataType).alias("p")).first()["p"]
    assert kind and got["l"] == [{"a_b": 1.5}, None] and got["s"]["t"] == "2024-01-02T03:04:05" and got["s"]["n"] is None


def test_lengths_are_filled(spark):
    df = spark.createDataFrame([("ab cd", "x", None), ("", "xyz", None), ("a", "b", 9)], "c string, t string, content_len int")
    got = [(r.content_len, r.word_len) for r in TX.fill_lengths(df, "c", "t").collect()]
    assert got == [(5, 2), (3, 1), (9, 1)]


def test_ratings_dates_ids(spark):
    assert one(spark, 'class="rating total_rating_9"', X.rating_from_suffix) == "4"
    assert one(spark, "none", X.rating_from_suffix) == "5"
    stars = '<img src="/Icon_Star_On.png">' * 4 + '<img src="icon_star_off.png">'
    assert one(spark, stars, X.rating_from_count) == "4"
    assert one(spark, "별점 3", X.rating_from_count) == "3"
    assert one(spark, "nothing", X.rating_from_count) is None
    assert one(spark, "작성 2024.01.02 수정 2024.02.03", X.extract_date) == "2024-01-02"
    assert one(spark, "no date", X.extract_date) is None
    assert one(spark, 'id="spnPaper77" onclick="fn_ToggleMyReviewPaper( 42 ,1)"', X.extract_id) == "42"
    assert one(spark, '<div id="paperShort_abc9">', X.extract_id) == "9"
    assert one(spark, "x", X.extract_id) is None
    assert one(spark, "https://x.y/Goods/123?goodsSortNo=7", lambda c: X.url_number(c, r"/Goods/(\d+)")) == "123"
    assert one(spark, "https://x.y/?a=1", lambda c: X.url_param(c, "goodsGb", "01")) == "01"


ALADIN = """
<div class="hundred_list"><div class="HL_star"><img src="icon_star_on"><img src="icon_star_on"></div>
<span id="spnPaper11">좋은&nbsp;책</span><div class="left"><span>2024-01-02</span></div></div>
<div class="hundred_list"><span id="spnPaper11">again</span><span>2024-01-03</span></div>
<div class="hundred_list">별점 3 <div id="paperShort_5"><div id="divPaper5">긴  리뷰 + 더보기</div></div> 2024-02-03</div>
<div class="hundred_list">그냥 <b>글</b></div>
<div class="footer">2019-01-01 <img src="icon_star_on"> 끝</div>"""
KYOBO = """
<div class="comment_item"><span class="filled-stars" style="width: 95%"></span><div class="comment_text">최고</div><i>2024.01.02</i></div>
<div class="comment_item"><div class="comment_text"></div><i>2024.01.05</i></div>
<div class="comment_item"><div class="comment_text">no date</div></div>
<div class="comment_item"><div class="comment_text">최고</div><i>2024.01.02</i></div><p>2020.01.01</p>"""
YES24 = """
<div class="reviewInfoGrp"><span class="review_rating"><span class="total_rating total_rating_8">x</span></span><em class="txt_date">2024-03-01</em>
<div class="reviewInfoBot crop"><div class="review_cont">short</div></div><div class="reviewInfoBot origin"><div class="review_cont"> 전체 <br/>내용</div></div></div>
<div class="reviewInfoGrp"><div class="reviewInfoBot origin"><div class="review_cont">둘째</div></div></div>
<div class="reviewInfoGrp"><div class="reviewInfoBot origin"><div class="review_cont"></div></div></div>
<div class="reviewInfoGrp"><div class="reviewInfoBot origin"><div class="review_cont">둘째</div></div></div>"""


def collected(spark, site, html, target=None):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = P.collect(P.extract_reviews(pages, P.PAGE_RULES[site]), P.PAGE_RULES[site], target)
    return [(r.rating, r.date, r.content) for r in rows.orderBy("page_id", "card_no").collect()]


def test_aladin_page(spark):
    assert collected(spark, "aladin", ALADIN) == [
        ("2", "2024-01-02", "좋은 책"), ("3", "2024-02-03", "긴 리뷰"), ("", "", "그냥 글")
    ]


def test_kyobo_page(spark):
    assert collected(spark, "kyobo", KYOBO) == [("9.5", "2024-01-02", "최고"), ("0.0", "2024-01-05", "")]


def test_yes24_page(spark):
    assert collected(spark, "yes24", YES24) == [("4", "2024-03-01", "전체 내용"), ("5", "", "둘째")]
    assert collected(spark, "yes24", YES24, target=1) == [("4", "2024-03-01", "전체 내용")]


def rated(spark, rows):
    return spark.createDataFrame(rows, "site string, date timestamp, rating double")


def test_empty_months_are_filled(spark):
    day = dt.datetime
    df = rated(spark, [("a", day(2024, 1, 31), 4.0), ("a", day(2024, 4, 1), 2.0), ("a", day(2024, 4, 30), 3.0), ("b", day(2023, 12, 5), 1.0)])
    counts = compare.monthly_count(df).orderBy("site", "month").collect()
    assert [(r.site, r.month.isoformat(), r.n_reviews) for r in counts] == [
        ("a", "2024-01-31", 1), ("a", "2024-02-29", 0), ("a", "2024-03-31", 0), ("a", "2024-04-30", 2), ("b", "2023-12-31", 1)
    ]
    means = [r.mean_rating for r in compare.monthly_mean(df).where("site = 'a'").orderBy("month").collect()]
    assert means == [4.0, None, None, 2.5]
    rolling = compare.rolling(compare.monthly_count(df), "n_reviews", 3).where("site = 'a'").orderBy("month").collect()
    assert [round(r.rolling_mean, 6) for r in rolling] == [1.0, 0.5, round(1 / 3, 6), round(2 / 3, 6)]


def test_histogram_edges_and_single_value(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 5)] + [("b", 3.0)], "site string, rating double")
    got = compare.histogram(df, "rating", 5).orderBy("site", "bin").collect()
    assert [r.n for r in got if r.site == "a"] == [1, 1, 1, 1, 2]
    assert [r.n for r in got if r.site == "b"] == [0, 0, 1, 0, 0]


def test_token_rates_for_hangul(spark):
    df = spark.createDataFrame([("a", "정말 좋은 책 정말"), ("b", "none")], "site string, t string")
    got = {(r.site, r.token): (r.n, r.rate) for r in compare.token_freq(df, "site", "t").collect()}
    assert got == {("a", "정말"): (2, pytest.approx(20000 / 3)), ("a", "좋은"): (1, pytest.approx(10000 / 3))}


def test_density_integrates_to_one(spark):
    df = spark.range(1, 400).select(F.lit("a").alias("site"), (F.col("id") % 97).cast("int").alias("n"))
    got = compare.length_density(df, "n", 200).orderBy("point").collect()
    area = sum(r.density for r in got) * (got[1].x - got[0].x)
    assert 0.85 < area < 1.0 and all(math.isfinite(r.density) for r in got)


def test_shared_dir_follows_the_session():
    class Session:
        def __init__(self, named, master="local[4]"):
            self.conf = {"spark.checkpoint.dir": named}
            self.sparkContext = self
            self.master = master

        def getConf(self):
            return {}

    assert session.run_dir(Session("hdfs://shared/state/"), "x").startswith("hdfs://shared/state/x-")
    own = session.shared_dir(Session(None))
    assert own == session.shared_dir(Session(None))
    for cluster in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            session.shared_dir(Session(None, cluster))
        assert session.shared_dir(Session("/shared", cluster)) == "/shared"


def test_run_folders_are_removed(spark):
    folder = session.run_dir(spark, "gone")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    session.remove_dir(spark, folder)
    assert keyed.read_table(spark, folder) is None


EVENTS = "ts timestamp, k string, v double"


@pytest.mark.parametrize("partition", [None, "k"])
def test_stream_ingest_restart_inserts_only_new_keys(spark, tmp_path, partition):
    src, table, mark = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    start = dt.datetime(2024, 1, 1)

    def arrive(rows):
        spark.createDataFrame([(start + dt.timedelta(days=d), k, 1.0) for d, k in rows], EVENTS).write.mode("append").parquet(src)

    def run():
        ingest.stream_ingest(spark.readStream.schema(EVENTS).parquet(src), table, mark, ["k"], "ts", partition)
        return sorted(r.k for r in spark.read.parquet(table).collect())

    arrive([(0, "a"), (0, "a"), (1, "b")])
    assert run() == ["a", "b"]
    arrive([(40, "a"), (41, "c")])
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    # A new key, weeks behind the newest event.
    arrive([(2, "d"), (40, "b")])
    assert run() == ["a", "b", "c", "d"]


def test_stream_partition_must_be_a_key(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest.stream_ingest(spark.readStream.schema(EVENTS).parquet(str(tmp_path)), "t", "c", ["k"], partition="v")


def test_stream_counts_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    base = dt.datetime(2024, 1, 30)
    rows = [(base + dt.timedelta(hours=5 * i), "k", float(i)) for i in range(30)]
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    ingest.run_counts(ingest.stream_counts(stream, F.col("v")), str(tmp_path / "t"), str(tmp_path / "c"))
    daily = ingest.latest_version(spark, str(tmp_path / "t")).select(F.col("w.start").cast("date").alias("day"), "n", "total")
    batch = spark.createDataFrame(rows, EVENTS).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    assert sorted(daily.collect()) == sorted(batch.collect())
    months = {r.month.month: r.n for r in ingest.roll_up_months(daily).collect()}
    assert sum(months.values()) == 30 and set(months) == {1, 2}


def test_day_counts_of_late_rows_keep_no_state(spark, tmp_path):
    """Rows of all days in every batch, batches folded: equal to the whole, whatever is replayed or half written."""
    src, table, mark = (str(tmp_path / x) for x in ("in", "t", "c"))
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(days=(i * 7) % 40), f"k{i}", float(i)) for i in range(200)]
    rows += [(None, "none", 1.0), (base, "no value", None)]
    for i in range(7):
        spark.createDataFrame(rows[i::7], EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS).parquet(src)
        ingest.run_day_counts(stream, F.col("v"), table, mark, open_batches=2)
    assert not (tmp_path / "c" / "state").exists()
    want = {}
    for ts, _, v in rows:
        n, total = want.get(ts and ts.date(), (0, None))
        want[ts and ts.date()] = (n + 1, total if v is None else (total or 0) + v)
    shown = lambda: {r.day: (r.n, r.total) for r in ingest.day_counts(spark, table).collect()}
    assert shown() == want
    folds, batches = ingest._open_counts(spark, table)
    assert folds and len(batches) <= 2 and len(ingest._finished(spark, f"{table}/batches")) < 7
    # The newest batch, which alone can be replayed, is never folded; a fold without its marker doesn't count.
    assert batches[-1] == 6
    (tmp_path / "t" / "folds" / "fold=6").mkdir()
    assert shown() == want
    ingest.fold_day_counts(spark, table)
    assert shown() == want
    assert ingest.day_counts(spark, str(tmp_path / "nothing")).count() == 0
