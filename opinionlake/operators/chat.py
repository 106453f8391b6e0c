"""Data steps around a chat answer: labels, subjects, context, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionlake.functions.values import normalize_label
from opinionlake.profiles import (
    DEFAULT_ROUTE,
    HIT_FIELDS,
    HIT_MISSING,
    HIT_UNKNOWN_SOURCE,
    NO_HITS_MESSAGE,
    ROUTE_LABELS,
    SITES,
    SUBJECT_FIELD_DEFAULT,
    SUBJECT_LABELS,
    SUBJECT_MISSING_MESSAGE,
)

HISTORY_SLICE = 4096


def route(label: Column) -> Column:
    return normalize_label(label, ROUTE_LABELS, DEFAULT_ROUTE)


def normalize_site(site: Column) -> Column:
    """Registered site name, NULL for any other."""
    return normalize_label(site, SITES, None)


def route_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(route(F.col(label)).alias("route")).agg(F.count("*").alias("n"))


def subject_text(key: Column, title: Column, author: Column, summary: Column, keywords: Column) -> Column:
    """Description of one subject; absent fields have a stated default."""
    known = F.lit(SUBJECT_FIELD_DEFAULT)
    label = {name: F.lit(f"{shown}: ") for name, shown in SUBJECT_LABELS.items()}
    line = F.lit("\n")
    head = F.concat(
        label["title"], F.coalesce(title, key), line,
        label["author"], F.coalesce(author, known), line,
        label["summary"], F.coalesce(summary, known),
    )
    tail = F.concat(line, label["keywords"], join_list(keywords))
    return F.concat(head, F.coalesce(tail, F.lit("")))


def join_list(words: Column) -> Column:
    """Comma-separated list, NULL when empty or absent."""
    return F.when(F.size(words) > 0, F.array_join(words, ", "))


def lookup_subject(wanted: DataFrame, subjects: DataFrame, key: str = "key") -> DataFrame:
    """Subject text per wanted key. No join hint: Spark broadcasts the
    dimension when its size allows and splits hot keys otherwise."""
    known = subjects.withColumn("known", F.lit(True))
    text = subject_text(*[F.col(c) for c in (key, "title", "author", "summary", "keywords")])
    return wanted.join(known, key, "left").withColumn(
        "response", F.when(F.col("known"), text).otherwise(F.lit(SUBJECT_MISSING_MESSAGE))
    ).select(*wanted.columns, "response")


def hit_line(rank: Column, source: Column, rating: Column, date: Column, content: Column) -> Column:
    first, second = (F.lit(f", {name}=") for name in HIT_FIELDS)
    missing = F.lit(HIT_MISSING)
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] ("), F.coalesce(source, F.lit(HIT_UNKNOWN_SOURCE)),
        first, F.coalesce(rating.cast("string"), missing), second, F.coalesce(date.cast("string"), missing),
        F.lit(") "), content,
    )


def context(questions: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Numbered hit lines per question, joined in rank order; questions
    without a hit get a fixed message. A question has at most k hits."""
    line = hit_line(*[F.col(c) for c in ("rank", "source", "rating", "date", "content")])
    lines = hits.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_lines"),
    )
    text = F.array_join(F.transform("_lines", lambda h: h["line"]), "\n")
    return questions.select(key).join(lines, key, "left").select(
        key, F.coalesce(F.size("_lines"), F.lit(0)).alias("n_hits"), F.coalesce(text, F.lit(NO_HITS_MESSAGE)).alias("context")
    )


def history(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Every message with its place in the running history.

    The history at a turn is the messages of the conversation up to its
    ``position``, in order; ``history_chars`` is the length of its lines
    joined by newlines. Written as one row per message, since repeating the
    whole text at each turn grows with the square of a conversation.

    Long conversations are cut into slices of turns. Running counts are taken
    within a slice, and the totals of earlier slices are added, so no task
    holds a whole conversation.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(turn) / HISTORY_SLICE)).withColumn(
        "line", F.concat(F.col("role"), F.lit(": "), F.col("text"))
    )
    chars = F.length("line") + 1
    totals = sliced.groupBy(conv, "_slice").agg(F.count("*").alias("_n"), F.sum(chars).alias("_c"))
    before = Window.partitionBy(conv).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        conv, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"),
    )
    within = Window.partitionBy(conv, "_slice").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_i", F.row_number().over(Window.partitionBy(conv, "_slice").orderBy(turn)))
        .withColumn("_r", F.sum(chars).over(within))
        .join(starts, [conv, "_slice"])
        .select(
            conv, turn, "role", "line",
            (F.col("_n0") + F.col("_i")).alias("position"),
            (F.col("_c0") + F.col("_r") - 1).alias("history_chars"),
        )
    )
