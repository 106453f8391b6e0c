"""Field rules for page text: numbers, dates, ids, URL parts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinionlake.functions.values import let

# Id spellings found in review cards, most reliable first.
CARD_ID_PATTERNS = (
    r"fn_ToggleCommentReviewPaper\('(\d+)'\)",
    r"fn_ToggleMyReviewPaper\(\s*(\d+)\s*,",
    r"fn_show_mypaper_utf8\(\s*(\d+)\s*,",
    r'id="spnPaper(\d+)"',
    r'id="div_commentReviewPaper(\d+)',
    r'id="(?:paperShort_|paperAll_|divPaper)\D*(\d+)',
)
# Where dates and ratings stand in page text.
DOTTED_DATE = r"\d{4}\.\d{2}\.\d{2}"
DASHED_DATE = r"\d{4}-\d{2}-\d{2}"
STAR_WIDTH = r"width:\s*([0-9.]+)%"
RATING_SUFFIX = r"total_rating_(\d+)"
STAR_ON = "icon_star_on"
RATING_WORD = r"별점\s*([1-5])"


def first_match(text: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """First non-empty match over patterns in priority order, else NULL."""
    found = [F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p, g in patterns]
    return F.coalesce(*found)


def extract_date(text: Column) -> Column:
    """First dashed or else dotted date in the text, written with dashes."""
    found = first_match(text, [(DASHED_DATE, 0), (DOTTED_DATE, 0)])
    return F.replace(found, F.lit("."), F.lit("-"))


def extract_id(text: Column, patterns: Sequence[str] = CARD_ID_PATTERNS) -> Column:
    return first_match(text, [(p, 1) for p in patterns])


def round_tenths(x: Column) -> Column:
    """To one decimal, by the exact value of the double; halves to even.

    Built-in rounding works on the shortest decimal text, by which 8.35 is a
    half; the double is a little less. The product 20 x is taken exactly, as a
    rounded product and its error, and compared with the odd number between
    the two candidates.
    """
    tens = F.floor(x * 10)
    # Splitting x into two halves makes both products exact.
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    product = x * 20
    error = (high * 20 - product) + (x - high) * 20
    above = (product - (tens * 2 + 1)) + error
    up = (above > 0) | ((above == 0) & (tens % 2 == 1))
    return (tens + F.when(up, 1).otherwise(0)) / F.lit(10.0)


def rating_from_width(text: Column) -> Column:
    """Star bar width in percent to a 10-point rating; 0.0 when absent."""
    percent = F.regexp_extract(text, STAR_WIDTH, 1).try_cast("double")
    return F.coalesce(round_tenths(percent / 10), F.lit(0.0))


def rating_from_suffix(text: Column) -> Column:
    """Class suffix on a 10-point scale to whole stars; 5 when absent."""
    found = F.regexp_extract(text, RATING_SUFFIX, 1).try_cast("int")
    return F.coalesce(F.floor(found / 2), F.lit(5)).cast("string")


def rating_from_count(text: Column, mark: str = STAR_ON, word: str = RATING_WORD, stars: Column | None = None) -> Column:
    """Number of lit star marks in the star block (the whole text if none is
    given), else the rating stated in the text, else NULL."""
    lit = F.regexp_count(F.lower(text if stars is None else stars), F.lit(mark))
    return F.when(lit > 0, lit.cast("string")).otherwise(first_match(text, [(word, 1)]))


def url_number(url: Column, pattern: str, default: str | None = None) -> Column:
    found = first_match(url, [(pattern, 1)])
    return F.coalesce(found, F.lit(default)) if default is not None else found


def url_param(url: Column, name: str, default: str | None = None) -> Column:
    """Query parameter; malformed URLs give the default."""
    found = F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit(""))
    return F.coalesce(found, F.lit(default)) if default is not None else found


# A reference to a character: by number, by name, or by one of the names that may stand without a semicolon.
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{1,31};|" + "|".join(OPEN_NAMES) + ")"
# What references to the control characters from 128 on mean: the characters of the old code page.
CONTROLS = {chr(c): bytes([c]).decode("cp1252", "ignore") for c in range(128, 160)}


def _by_number(reference: Column) -> Column:
    """The character of a reference like ``&#233;`` or ``&#xe9;``; of a number without a character, U+FFFD."""
    code = F.regexp_replace(F.regexp_extract(reference, "#([xX]?[0-9A-Fa-f]+)", 1), "^([xX]?)0+", "$1")
    digits = F.when(F.length(code) > 8, "FFFFFFFF").when(code.rlike("^[xX]"), F.substring(code, 2, 7)).otherwise(F.conv(code, 10, 16))
    number = F.conv(digits, 16, 10).cast("long")
    known = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    shown = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
    old = {c: m for c, m in CONTROLS.items() if m}
    return F.when(known, F.translate(shown, "".join(old), "".join(old.values()))).otherwise("\ufffd")


def decode_entities(text: Column) -> Column:
    """Character references as characters, each once: by number, or by any name of the standard table. Unknown names
    stay as they are."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    named = lambda r: F.coalesce(F.try_element_at(table, F.substr(r, F.lit(2))), r)
    shown = F.transform(
        F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda r: F.when(r.startswith("&#"), _by_number(r)).otherwise(named(r))
    )
    joined = F.zip_with(F.split(text, REFERENCE, -1), shown, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    return let(F.when(text.contains("&"), F.array_join(joined, "")).otherwise(text), lambda t: t)


def until_close(html: Column, tag: str) -> Column:
    """What comes before the closing tag of an element whose opening tag stands
    just before ``html``; elements of the same name inside it are passed over.
    Everything, if it is never closed."""
    step = lambda p: (
        F.when(p.rlike(f"(?i)^</{tag}[\\s>]"), -1)
        .when(p.rlike(f"(?i)^<{tag}(\\s[^>]*)?/>"), 0)
        .when(p.rlike(f"(?i)^<{tag}[\\s>]"), 1)
        .otherwise(0)
    )
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def inside(pieces: Column) -> Column:
        walked = F.aggregate(
            F.transform(pieces, step),
            start,
            lambda s, d: F.struct(
                F.when(s["depth"] == 0, 0).otherwise(s["depth"] + d).alias("depth"),
                F.when((s["depth"] == 0) | (s["depth"] + d == 0), s["n"]).otherwise(s["n"] + 1).alias("n"),
            ),
        )
        return F.array_join(F.slice(pieces, 1, walked["n"]), "")

    return let(F.split(html, f"(?i)(?=</?{tag}[\\s/>])", -1), inside)


def inner(html: Column, opening: str, tag: str) -> Column:
    """Markup inside the first element whose opening tag matches, else empty."""
    return until_close(F.regexp_extract(html, f"(?s){opening}[^>]*>(.*)$", 1), tag)
