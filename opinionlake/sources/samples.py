"""Review-shaped tables derived from the given star-schema tables.

``raw_reviews`` plants bad ratings, bad and future dates, missing texts,
out-of-range ratings and exact copies, so every cleaning rule has work to do.
Each document gives one review; every 31st also gives a copy. Sequence
numbers are unique at any scale: 2 * doc_id, and the next odd number for the
copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared schemas: no job reads a footer to find them.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_seq, site, rating, date, content), all but the key as text."""
    # Both joins are on the id. Texts are dealt by it first, so that one large row group is not one task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts, "doc_id")
    stars = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.floor("value").cast("long").alias("v")
    )
    days = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("day")
    )
    doc = F.col("doc_id")
    site = F.when(doc % 3 == 0, "aladin").when(doc % 3 == 1, "kyobo").otherwise("yes24")
    rating = (
        F.when(doc % 17 == 0, "n/a")
        .when(doc % 3 == 1, (F.col("v") % 12).cast("string"))
        .otherwise((1 + F.col("v") % 6).cast("string"))
    )
    date = (
        F.when(doc % 19 == 0, "not-a-date")
        .when(doc % 23 == 0, "2999-01-01")
        .when(doc % 37 == 0, F.date_format("day", "yyyy-MM-dd 09:30"))
        .when(doc % 41 == 0, F.date_format("day", "yyyy-M-d'T'00:00:00.5'Z'"))
        .when(doc % 43 == 0, F.date_format("day", "yyyyMMdd"))
        .otherwise(F.col("day").cast("string"))
    )

    def row(copy: int):
        return F.struct((doc * 2 + copy).alias("review_seq"), rating.alias("rating"), date.alias("date"))

    copies = F.when(doc % 31 == 0, F.array(row(0), row(1))).otherwise(F.array(row(0)))
    return (
        docs.join(stars, "doc_id")
        .join(days, "doc_id")
        .select(site.alias("site"), F.when(doc % 29 != 0, F.col("text")).alias("content"), F.inline_outer(copies))
        .select("review_seq", "site", "rating", "date", "content")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User snapshot: one row per customer."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("pw"), (key % 97).cast("string")).alias("password"),
        F.col("c_name").alias("username"),
    )


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change feed over all orders; ``seq`` gives the order. Some addresses
    are malformed and some belong to nobody yet."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    domain = (
        F.when(key % 13 == 0, "example.com")
        .when(key % 7 == 0, "@example.org")
        .otherwise("@example.com")
    )
    password = F.when(key % 3 == 0, F.concat(F.lit("pw"), (cust % 97).cast("string"))).otherwise(
        F.concat(F.lit("new"), (key % 89).cast("string"))
    )
    op = F.when(key % 4 == 0, "register").when(key % 4 == 1, "login").when(key % 4 == 2, "update").otherwise("delete")
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        op.alias("op"),
        F.concat(F.lit("user"), cust.cast("string"), domain).alias("email"),
        password.alias("password"),
        F.concat(F.lit("name"), (key % 11).cast("string")).alias("username"),
    )


FOOTER = '<div class="footer"><div>1999-09-09 1999.09.09</div> footer &copy;</div></body></html>'


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, site, html): a shop page with one review card per document.

    Its rating, date and text come from the given tables. Texts hold character
    references and elements inside elements, and long ones end with a marker; a star outside the star block and
    a dated footer stand on the page too, and some cards have no date.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts, "doc_id")
    values = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "value")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("day"))
    doc = F.col("doc_id")
    tenths = F.floor(F.col("value") * 10) % 1001
    width = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    text = F.col("text")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))

    def date(pattern: str):
        return F.when(doc % 19 == 0, "").otherwise(F.date_format("day", pattern))

    star = F.lit('<img src="Icon_Star_On.png">')
    aladin = F.concat(
        F.lit('<div class="hundred_list x"><div class="HL_star">'), F.expr("repeat('<img src=\"Icon_Star_On.png\">', cast(doc_id % 6 as int))"),
        F.lit('<img src="icon_star_off.png"></div>'), F.when(doc % 4 == 0, "별점 3 ").otherwise(""),
        F.when(doc % 5 == 0, star).otherwise(F.lit("")), F.when(doc % 7 == 0, '<div id="divPaper').otherwise('<span id="spnPaper'),
        doc.cast("string"), F.lit('">A &amp; B&#39;s <span>in</span> tail caf&eacute; &amp;lt; 5&euro; &copy &szlig;&#150; '), text,
        F.when(doc % 7 == 0, " + 더보기 </div>").otherwise("</span>"), F.lit('<div class="left"><span>'), date("yyyy-MM-dd"),
        F.lit("</span></div></div>"),
    )
    kyobo = F.concat(
        F.lit('<div class="comment_item"><span class="filled-stars" style="width: '), width,
        F.lit('%"></span><div class="comment_text">A &amp; B&nbsp;<div>in</div> tail '), text, F.lit("</div><i>"),
        date("yyyy.MM.dd"), F.lit("</i></div>"),
    )
    yes24 = F.concat(
        F.lit('<div class="reviewInfoGrp lnkExtend"><span class="review_rating"><span class="total_rating total_rating_'),
        (doc % 11).cast("string"), F.lit('">x</span></span><em class="txt_date">'), date("yyyy-MM-dd"),
        F.lit('</em><div class="reviewInfoBot crop"><div class="review_cont">short</div></div>'),
        F.lit('<div class="reviewInfoBot origin"><div class="review_cont">A &#x26; B <div>in</div> tail '), text,
        F.lit("</div></div></div>"),
    )
    site = F.when(doc % 3 == 0, "aladin").when(doc % 3 == 1, "kyobo").otherwise("yes24")
    card = F.when(site == "aladin", aladin).when(site == "kyobo", kyobo).otherwise(yes24)
    page = F.concat(F.lit("<html><body><div>"), F.lit("top</div>"), card, F.lit(FOOTER))
    return docs.join(values, "doc_id").join(days, "doc_id").select(doc.alias("page_id"), site.alias("site"), page.alias("html"))
