"""Documents that operators must not stumble over, and the folder of the given tables."""

SF = "/root/testdata/sf0.01"

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, start long, "
    "component_id string, bucket long, sig string, llm__shard long, llm__row long, dedup__n_words string, dedup__sha256 long, c1 string"
)


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; names that operators use themselves."""
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [
        (1, passage + " one tail"),
        (2, "head " + passage),
        (2, "head " + passage),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (None, passage),
        (6, "a b c"),
        (7, "A b c"),
        (8, "한국어 문장 " * 30),
        (9, "x" * 300_000),
        (10, ("lorem ipsum dolor sit amet " * 9000) + "end"),
        (11, "emoji 😀 and \u0000 control\u001c here"),
        (12, "one line\nSPDX-License-Identifier: MIT OR (GPL-2.0-only AND Apache-2.0)\nall rights reserved"),
        (13, "the cat the cat the cat the cat sat on the general public license cc by mat"),
    ]
    return [
        (i, t, None if n % 5 == 0 else "en", None, None, None, None, "x", None, None, n, 7, "mine", n, "c")
        for n, (i, t) in enumerate(texts)
    ]
