"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts: ``text`` as it is, and images, audio and
documents, which the visitor replaces by numbered placeholders in their order
in the conversation. For each of these it records the reference and the number
of tokens the placeholder stands for. A conversation becomes one string:

    <|turn|>user<|body|>text<|end|>            turns that are not learned
    <|turn|>assistant<|loss|>text<|end|>       turns under the loss mask

Inside roles and texts a backslash is doubled and ``<|`` is written ``<\\|``,
so no marker can occur in them; taking one backslash away before any character
gives them back. ``read_back`` needs the formatted string only.

Turns are ordered by (turn, role, text), nulls first, where text is that of all
text parts together; what is equal there by the other parts. One window and one
aggregation over conv_id share a single shuffle by conversation. A conversation
is one row of the result and must fit in memory there, as the contract asks for
digests over whole conversations; different conversations never meet.

Cases: a null text is empty, a null role is empty and not learned; a null
conv_id is a conversation of its own (id null); repeated rows are turns of
their own; a part of an unknown kind is flattened as a document; null parts are
left out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionlake.llm.registry import ORACLES, query, table

TURN, BODY, LOSS, END = "<|turn|>", "<|body|>", "<|loss|>", "<|end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"

# Tokens per unit: image tiles, seconds of sound, pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A plain text as a content of one part."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))
    )


def _known(kind: Column) -> Column:
    """The kind of an attachment; whatever is not named above counts as a document."""
    return F.when(kind.isin(*TOKENS_PER_UNIT), kind).otherwise("document")


def _tokens(part: Column) -> Column:
    per = F.lit(TOKENS_PER_UNIT["document"])
    for kind, n in TOKENS_PER_UNIT.items():
        per = F.when(_known(part["kind"]) == kind, n).otherwise(per)
    return (F.coalesce(part["units"], F.lit(0)) * per).cast("long")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("")) == "text"


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, n_tokens_attached) from (conv_id, turn, role, parts).

    ``loss_spans`` has start (from 0) and length, in characters of the formatted string, of each learned text.
    ``attachments`` has number, kind, ref, turn position and expanded tokens of each placeholder.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "sort_text", "sort_parts")
    texts = F.transform(F.filter("parts", _is_text), lambda p: p["text"])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = F.filter(F.col("parts").cast(PARTS), lambda p: p.isNotNull())
    turns = (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(PARTS)).alias("parts"))
        .withColumn("sort_text", F.when(F.exists(texts, lambda t: t.isNotNull()), F.array_join(texts, "")))
        .withColumn("sort_parts", F.to_json("parts"))
        .withColumn("attached", F.filter("parts", lambda p: ~_is_text(p)))
        .withColumn("ahead", F.coalesce(F.sum(F.size("attached")).over(before), F.lit(0)))
        .withColumn("position", F.row_number().over(order) - 1)
    )
    kinds = F.transform("parts", lambda p: F.when(_is_text(p), 0).otherwise(1))
    number = lambda i: F.col("ahead") + F.aggregate(F.slice(kinds, 1, i + 1), F.lit(0), lambda a, x: a + x)
    pieces = F.transform(
        "parts",
        lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), _known(p["kind"]), F.lit(":"), number(i).cast("string"), F.lit("|>"))
        ),
    )
    learned = F.col("role") == "assistant"
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.when(learned, LOSS).otherwise(BODY))
    laid_out = (
        turns.withColumn("head", head)
        .withColumn("content", F.array_join(pieces, ""))
        .withColumn("piece", F.concat("head", "content", F.lit(END)))
        .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
        .withColumn(
            "span",
            F.when(learned, F.struct((F.col("at") + F.length("head")).alias("start"), F.length("content").cast("long").alias("length"))),
        )
        .withColumn(
            "notes",
            F.transform(
                "attached",
                lambda p, i: F.struct(
                    (F.col("ahead") + i + 1).alias("number"), _known(p["kind"]).alias("kind"), p["ref"].alias("ref"),
                    F.col("position").alias("position"), _tokens(p).alias("tokens"),
                ),
            ),
        )
    )
    together = F.sort_array(F.collect_list(F.struct("position", "piece", "span", "notes")))
    return (
        laid_out.groupBy("conv_id")
        .agg(together.alias("turns"))
        .select(
            "conv_id",
            F.array_join("turns.piece", "").alias("formatted"),
            F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
            F.flatten("turns.notes").alias("attachments"),
        )
        .withColumn("attached_tokens", F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, x: a + x))
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, learned), unescaped; placeholders stay as text."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^(.*?)<\|(?:body|loss)\|>", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^.*?<\|(?:body|loss)\|>(.*)<\|end\|>$", 1)).alias("text"),
            (F.regexp_extract(p, r"(?s)^.*?<\|(body|loss)\|>", 1) == "loss").alias("learned"),
        ),
    )


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.inline(
            F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))
        )
    )
    chats = format_chats(given.unionByName(extra).withColumn("parts", text_part(F.col("text"))))
    turns = F.col("turns")
    spoken = F.array_join(F.transform(F.filter(turns, lambda t: t["learned"]), lambda t: t["text"]), "")
    script = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        chats.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("spoken", spoken)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(script, 256).alias("turns_sha256"),
            F.length("spoken").cast("long").alias("loss_chars"),
            F.sha2("spoken", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


ORACLES["op7_chat"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), laid AS (
  SELECT *, role || chr(10) || text || chr(10) AS line,
    8 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + 8
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 7 AS chars
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(line, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM laid GROUP BY conv_id
"""
