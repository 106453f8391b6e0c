"""Licence scans: identifier tags, notice phrases and licence expressions.

One Aho-Corasick automaton finds all notice phrases in a text reduced to its
words, in one pass. Identifier tags (``SPDX-License-Identifier:`` and the like)
are found by a second automaton in the text itself; what follows one up to the
end of its line is a licence expression, which a shunting-yard parser turns
into postfix order and evaluates: its licences, and whether they permit use
(``and``: all must, ``or``: one must, ``with``: an exception goes with the
licence before it and leaves its answer unchanged).

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z, counted from 0. A phrase is found wherever its words stand one after the
other, overlaps included. Texts are scanned where they are read; nothing is
shuffled, and the automata are built from the fixed tables below.

Cases: a null or empty text has no words and no labels; a tag whose expression
cannot be parsed gives no label; unknown licence names become labels as they
are written (lower case), and permit nothing; rows that share an id are scanned
each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionlake.llm import bytesio as B
from opinionlake.llm.registry import query, table

# Phrases and labels of the base scan (fixed values of the contract).
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Further notice phrases, as words, and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "isc license": "isc",
    "unlicense": "unlicense",
    "proprietary and confidential": "reserved",
}

TAGS = ("spdx-license-identifier:", "license-expression:", "license-identifier:")

# Families whose licences permit use in a training corpus.
PERMISSIVE = {
    "mit", "apache", "bsd", "isc", "cc0", "cc-by", "public-domain", "unlicense", "zlib", "mpl",
}

TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}


class Finding(NamedTuple):
    words: int
    places: int
    first: int | None
    last: int | None
    base: list[str]
    labels: list[str]
    permits: bool | None
    tags: int


def family(name: str) -> str:
    """An identifier without its version: apache-2.0-only is apache."""
    return re.sub(r"(-v?\d[\d.]*)?(-only|-or-later|\+)?(-clause)?$", "", name) or name


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, or None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in TOKEN.findall(expression):
        if token in RANK:
            if operand:
                return None
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                # Words after a whole expression are no part of it.
                break
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(order: list[str]) -> tuple[set[str], bool]:
    """(licence families, may it be used) of an expression in postfix order."""
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token in RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            elif token == "and":
                stack.append((left[0] | right[0], left[1] and right[1]))
            else:
                stack.append((left[0] | right[0], left[1] or right[1]))
        else:
            stack.append(({family(token)}, family(token) in PERMISSIVE))
    return stack[-1]


def automaton(keys) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, value in keys:
        out.add_word(key, value)
    out.make_automaton()
    return out


def _to_words() -> bytes:
    """Byte table: word bytes in lower case, all others a space."""
    keep = B.byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
    return bytes(int(B.LOWER[b]) if keep[B.LOWER[b]] else 0x20 for b in range(256))


class Scanner:
    """Both automata; made once per task. Texts go through as one character per byte."""

    def __init__(self) -> None:
        phrases = {**{p: (n, False) for p, n in NOTICES.items()}, **{p: (n, True) for p, n in BASE_PHRASES.items()}}
        self.phrases = automaton((f" {p} ", (p, *v)) for p, v in phrases.items())
        self.tags = automaton((t, len(t)) for t in TAGS)
        self.table = _to_words()

    def scan(self, text: bytes) -> Finding:
        words = text.translate(self.table).split()
        base: set[str] = set()
        labels: set[str] = set()
        places, first, last = 0, None, None
        line = f" {b' '.join(words).decode('latin-1')} "
        word, at = 0, 0
        found = sorted((end - len(p) - 1, p, name, is_base) for end, (p, name, is_base) in self.phrases.iter(line))
        for start, _, name, is_base in found:
            labels.add(name)
            if is_base:
                word += line.count(" ", at, start)
                at = start
                base.add(name)
                places += 1
                first = word if first is None else first
                last = word
        answers, tags = [], 0
        low = text.lower()
        if any(t.encode() in low for t in TAGS):
            plain = low.decode("latin-1")
            taken = -1
            for end, _ in self.tags.iter(plain):
                if end == taken:
                    continue
                taken = end
                stop = re.compile(r"[\n\r]|$").search(plain, end + 1).start()
                order = postfix(plain[end + 1 : stop])
                if order:
                    names, permits = evaluate(order)
                    labels |= names
                    answers.append(permits)
                    tags += 1
        if answers:
            permits = all(answers)
        else:
            permits = all(x in PERMISSIVE for x in labels) if labels else None
        return Finding(len(words), places, first, last, sorted(base), sorted(labels), permits, tags)


SCAN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("permits", T.BooleanType()),
        T.StructField("n_tags", T.LongType()),
    ]
)


def scan(docs: DataFrame) -> DataFrame:
    """Findings of every row of ``docs``: words, base places, labels, expressions and whether they permit use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            data, at = B.column_bytes(batch.column("text"))
            found = [scanner.scan(data[at[i] : at[i + 1]].tobytes()) for i in range(batch.num_rows)]
            cols = list(zip(*found, strict=True)) if found else [()] * len(Finding._fields)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(list(c), pa.int64()) for c in cols[:4]),
                    *(pa.array([",".join(x) for x in c], pa.string()) for c in cols[4:6]),
                    pa.array(list(cols[6]), pa.bool_()),
                    pa.array(list(cols[7]), pa.int64()),
                ],
                names=SCAN.names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score: how well a document's licence is known. 1 for a parsed identifier tag, 0.8 for one family named in
    notices, less for each further family; 0 without any."""
    names = F.size(F.split("labels", ","))
    return scan(table(spark, sf_dir, "documents")).withColumn(
        "score", F.when(F.col("n_tags") > 0, 1.0).when(F.col("labels") == "", 0.0).otherwise(0.8 / names)
    )
