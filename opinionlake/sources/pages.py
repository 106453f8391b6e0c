"""Pages of html to review rows, for a table of any number of pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake.functions import extract as X
from opinionlake.functions.text import fix_nbsp, once, strip_tail
from opinionlake.functions.values import let, signature, strip
from opinionlake.operators.ranking import first_by, head_per


def page_blocks(pages: DataFrame, pattern: str = r"(?s)<p>(.*?)</p>") -> DataFrame:
    """(page_id, block_no, block): every match of a block pattern."""
    found = F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(1))
    return pages.select("page_id", found.alias("_b")).select(
        "page_id", F.posexplode_outer("_b").alias("block_no", "block")
    ).where(F.col("block").isNotNull())


def plain_text(html: Column) -> Column:
    """Text of a piece of markup: no tags, characters for their references, blanks normalised."""
    text = X.decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", " "))
    return strip(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def element_text(block: Column, opening: str, closing: str) -> Column:
    """Text of the first element whose opening tag matches, else NULL."""
    return let(plain_text(X.inner(block, opening, closing.strip("</>"))), lambda t: F.nullif(t, F.lit("")))


@dataclass(frozen=True)
class PageRules:
    """How one shop's page holds its reviews."""

    site: str
    card: str  # opening of one review card
    rating: Callable[[Column], Column]
    date: Callable[[Column], Column]
    content: Callable[[Column], Column]
    review_id: Callable[[Column], Column]
    keys: tuple[str, ...]
    needs_date: bool = False
    needs_content: bool = True


def _hundred_or_long(card: Column) -> Column:
    """Short review text, else the long review's, else the whole card."""
    return F.coalesce(
        element_text(card, r'id="spnPaper\d+"', "</span>"),
        F.nullif(strip_tail(element_text(card, r'id="divPaper\d+"', "</div>")), F.lit("")),
        F.nullif(strip_tail(element_text(card, r'id="paperShort_\w*"', "</div>")), F.lit("")),
        element_text(card, r'id="paperAll_\w*"', "</div>"),
        plain_text(card),
    )


# Markers of review cards and fields in the shops' pages.
PAGE_RULES = {
    "aladin": PageRules(
        site="aladin",
        card=r'<div[^>]*class="hundred_list[^"]*"[^>]*>',
        rating=lambda c: F.coalesce(
            X.rating_from_count(plain_text(c), stars=X.inner(c, r'<div[^>]*class="[^"]*HL_star', "div")), F.lit("")
        ),
        date=lambda c: F.coalesce(X.first_match(plain_text(c), [(X.DASHED_DATE, 0)]), F.lit("")),
        content=lambda c: F.coalesce(fix_nbsp(_hundred_or_long(c)), F.lit("")),
        review_id=X.extract_id,
        keys=("review_id",),
    ),
    "kyobo": PageRules(
        site="kyobo",
        card=r'<div[^>]*class="comment_item[^"]*"[^>]*>',
        rating=lambda c: X.rating_from_width(
            F.regexp_extract(c, r'class="filled-stars"[^>]*style="([^"]*)"', 1)
        ).cast("string"),
        date=lambda c: F.replace(X.first_match(plain_text(c), [(X.DOTTED_DATE, 0)]), F.lit("."), F.lit("-")),
        content=lambda c: F.coalesce(element_text(c, r'class="comment_text"', "</div>"), F.lit("")),
        review_id=lambda c: F.lit(None).cast("string"),
        keys=("date", "content"),
        needs_date=True,
        needs_content=False,
    ),
    "yes24": PageRules(
        site="yes24",
        card=r'<div[^>]*class="reviewInfoGrp[^"]*"[^>]*>',
        rating=lambda c: X.rating_from_suffix(F.regexp_extract(c, r'(?s)class="[^"]*review_rating.*', 0)),
        date=lambda c: F.coalesce(element_text(c, r'<em[^>]*class="txt_date"', "</em>"), F.lit("")),
        content=lambda c: F.coalesce(
            element_text(c, r'class="reviewInfoBot origin".*?class="review_cont"', "</div>"), F.lit("")
        ),
        review_id=lambda c: F.lit(None).cast("string"),
        keys=("content",),
    ),
}


def extract_reviews(pages: DataFrame, rules: PageRules) -> DataFrame:
    """(page_id, card_no, review_id, site, rating, date, content) as text.

    A card ends with its own closing tag, or at the next card. Rows a shop's
    rules need a date or content for, and lack it, are dropped.
    """
    cards = pages.select("page_id", F.split("html", rules.card).alias("_c")).select(
        "page_id", F.posexplode_outer("_c").alias("card_no", "card")
    ).where(F.col("card_no") > 0).withColumn("card", once(X.until_close(F.col("card"), "div")))
    card = F.col("card")
    fields = F.struct(rules.rating(card).alias("rating"), rules.date(card).alias("date"), rules.content(card).alias("content"))
    rows = cards.select(
        "page_id", "card_no", rules.review_id(card).alias("review_id"), F.lit(rules.site).alias("site"), once(fields).alias("_f")
    ).select("page_id", "card_no", "review_id", "site", "_f.*")
    rows = rows.withColumn(
        "review_id", F.coalesce("review_id", signature(F.col("date"), F.col("rating"), F.col("content")))
    )
    if rules.needs_date:
        rows = rows.where(F.col("date").isNotNull())
    return rows.where(F.col("content") != "") if rules.needs_content else rows


def collect(rows: DataFrame, rules: PageRules, target: int | None = None) -> DataFrame:
    """First copy of each review in page order, with ``target`` the first so
    many of them; without it all, and no position."""
    order = ["page_id", "card_no"]
    kept = first_by(rows, list(rules.keys), [F.col(c) for c in order])
    return kept if target is None else head_per(kept, ["site"], order, target)
