"""Coercion, date parts, keys and plain-value expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.profiles import DATE_FORMATS, NA_TOKENS, WEEKDAY_NAMES

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
BLANK_ENDS = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"


def na_to_null(column: str, tokens: Sequence[str] = NA_TOKENS) -> Column:
    listed = ", ".join("'" + t.replace("'", "\\'") + "'" for t in tokens)
    return F.expr(f"CASE WHEN `{column}` NOT IN ({listed}) THEN `{column}` END")


def to_number(value: Column) -> Column:
    """Text to double; anything that is not a plain number is NULL."""
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def strip(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(value, BLANK_ENDS, "")


# A day with or without a time: parts with or without leading zeros, fractions, and a zone.
SPELLED = (
    r"^(\d{4})(?:([-./])(\d{1,2})\2(\d{1,2})|(\d{2})(\d{2}))"
    r"(?:[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2}(?:[.,]\d{1,9})?))?\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def _spelled_moment(text: Column) -> Column:
    """Any other spelling of the standard for dates; with a zone, the moment in the session's time."""
    part = lambda g: F.nullif(F.regexp_extract(text, SPELLED, g), F.lit(""))
    number = lambda *gs: F.coalesce(*[part(g).cast("int") for g in gs])
    zone = F.regexp_replace(F.nullif(part(10), F.lit("Z")), r"^(...)(?::?(..))?$", "$1:$2")
    zone = F.when(part(10) == "Z", "UTC").otherwise(F.when(F.length(zone) == 4, F.concat(zone, F.lit("00"))).otherwise(zone))
    seconds = F.coalesce(F.replace(part(9), F.lit(","), F.lit(".")).cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    nothing = F.lit(0)
    made = F.try_make_timestamp(
        part(1).cast("int"), number(3, 5), number(4, 6), F.coalesce(number(7), nothing), F.coalesce(number(8), nothing),
        seconds, F.coalesce(zone, F.current_timezone()),
    )
    return F.when(text.rlike(SPELLED), made)


def to_moment(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to a moment: the usual spellings first, then any other with a day, time, fraction or zone; else NULL.

    The rare spellings are read inside ``let``, which keeps the generated code of a stage below what Java compiles.
    """
    text = strip(value)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], let(text, _spelled_moment))


def to_five(rating: Column, scale: int | Column) -> Column:
    """Bring a rating onto the 5-point scale."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    return rating * F.lit(5.0) / scale


def weekday_name(date: Column) -> Column:
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.element_at(names, F.weekday(date) + 1)


def date_parts(date: Column) -> dict[str, Column]:
    """Year, month, weekday (Monday 0), its name, weekend flag, month label."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "weekday": F.weekday(date),
        "weekday_name": weekday_name(date),
        "is_weekend": (F.weekday(date) >= 5).cast("int"),
        "year_month": F.date_format(date, "yyyy-MM"),
    }


def month_of(date: Column) -> Column:
    return F.trunc(date, "month")


def key_text(value: Column, missing: str = "nan") -> Column:
    return F.coalesce(value, F.lit(missing))


def rating_text(rating: Column) -> Column:
    """Canonical text of a rating held as text: ``5`` and ``5.0`` agree."""
    return F.coalesce(to_number(rating).cast("string"), rating)


def content_key(*parts: Column) -> Column:
    """sha256 hex over the parts joined by ``||``; a missing part is ``nan``."""
    joined = [key_text(parts[0])]
    for part in parts[1:]:
        joined += [F.lit("||"), key_text(part)]
    return F.sha2(F.concat(*joined), 256)


def signature(date: Column, rating: Column, content: Column) -> Column:
    """md5 hex of ``date|rating|content``, the key of rows without an id."""
    bar = F.lit("|")
    return F.md5(
        F.concat(key_text(date, ""), bar, key_text(rating, ""), bar, key_text(content, ""))
    )


def safe_key(key: Column) -> Column:
    """Field name without NUL, dots, dollars or blanks; never empty."""
    plain = F.translate(key, ".$\u0000", "__")
    blanked = F.regexp_replace(plain, r"[\s\p{Z}]+", "_")
    return F.coalesce(F.nullif(F.trim(blanked, F.lit("_")), F.lit("")), F.lit("_"))


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def iso_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def plain_value(value: Column, kind: T.DataType) -> Column:
    """A value of any type in its plain form: NaN as NULL, moments as ISO
    text, keys of maps as field names; lists, maps and records throughout.

    Keys that become equal keep the last value, as plain fields would.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return iso_text(value.cast("timestamp"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: plain_value(v, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.map_entries(value)
        names = F.transform(entries, lambda e: safe_key(e["key"].cast("string")))
        # Of equal names the last entry stays.
        last = F.filter(
            F.transform(entries, lambda e, i: F.struct(F.get(names, i).alias("key"), plain_value(e["value"], kind.valueType).alias("value"), i.alias("i"))),
            lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.greatest(F.size(names), F.lit(1))), e["key"]),
        )
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[plain_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def valid_email(value: Column) -> Column:
    return F.coalesce(value.rlike(EMAIL), F.lit(False))


def normalize_label(label: Column, allowed: Sequence[str], default: str | None) -> Column:
    """Stripped, lowercased label; anything outside ``allowed`` is ``default``."""
    plain = F.lower(strip(label))
    return F.when(plain.isin(*allowed), plain).otherwise(F.lit(default))
