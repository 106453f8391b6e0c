"""Text expressions: cleaning, lengths, tokens, n-grams. Built-ins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinionlake.functions.values import strip
from opinionlake.profiles import KEPT_RANGES, Profile

NBSP = "\u00a0"


def outside(marks: str) -> str:
    """Regex class of all characters that are not kept, as ascending ranges.

    Java tests such a list several times faster than the negated class.
    """
    kept = sorted([(ord(a), ord(b)) for a, b in KEPT_RANGES] + [(ord(m), ord(m)) for m in marks])
    gaps, start = [], 0
    for low, high in kept:
        if low > start:
            gaps.append((start, low - 1))
        start = high + 1
    gaps.append((start, 0x10FFFF))
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in gaps) + "]"


def clean_text(text: Column, profile: Profile) -> Column:
    """Kept characters with single blanks between; one regex pass."""
    return F.trim(F.regexp_replace(text, outside(profile.marks) + "+", " "))


def once(value: Column) -> Column:
    """The value, computed in one place.

    Filters on a plain expression are pushed below it and compute it again;
    they are not pushed through a generator.
    """
    return F.explode(F.array(value))


def char_len(text: Column) -> Column:
    return F.length(text)


def word_len(text: Column) -> Column:
    """Words in blank-normalised text; empty text has none."""
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", 0).otherwise(blanks + 1).cast("int")


def fill_lengths(df, *texts: str, chars: str = "content_len", words: str = "word_len"):
    """Lengths a table lacks, as columns or as values, from its first text."""
    text = first_text(*[F.col(t) for t in texts])
    made = {chars: char_len(text), words: word_len(text)}
    return df.withColumns({n: F.coalesce(F.col(n), v) if n in df.columns else v for n, v in made.items()})


def fix_nbsp(text: Column) -> Column:
    return strip(F.replace(text, F.lit(NBSP), F.lit(" ")))


def strip_tail(text: Column, marker: str = r"\+\s*더보기") -> Column:
    """Drop a trailing marker, then normalise blanks."""
    cut = F.regexp_replace(text, marker + r"\s*$", "")
    return F.trim(F.regexp_replace(cut, r"[\s\p{Z}]+", " "))


def blank_tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: F.length(t) >= 2)


def word_tokens(text: Column) -> Column:
    """Runs of two or more word characters, in any text."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def drop_stopwords(tokens: Column, words: Sequence[str]) -> Column:
    """Exact matches only; repeats of other tokens stay."""
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*words))


def tokens(text: Column, profile: Profile) -> Column:
    folded = F.lower(text) if profile.lowercase else text
    # Cleaned text without marks holds word characters and blanks only, so
    # its word runs are its blank-separated parts; splitting is cheaper.
    by_blank = profile.tokens == "blank" or not profile.marks
    split = profile.tokenizer or (blank_tokens if by_blank else word_tokens)
    return drop_stopwords(split(folded), profile.stopwords)


def with_bigrams(words: Column) -> Column:
    """Tokens followed by neighbouring pairs joined by a blank."""
    left = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    right = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_text(*columns: Column) -> Column:
    """First non-empty text in the order given; the last one as it is."""
    *early, last = columns
    return F.coalesce(*[blank_to_null(c) for c in early], last)
