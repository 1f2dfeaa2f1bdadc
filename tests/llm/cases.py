"""Small tables with the hard cases: nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _id string, _size int, word string, size string"


def hard_rows():
    long_text = "alpha beta gamma delta " * 4000
    rows = [
        (1, "one two three four five", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \t\n ", "de", None),
        (5, long_text, "en", "a"),
        (6, long_text, "en", "a"),
        (7, "é" * 500 + " größe", "fr", "c"),
        (8, "same same same same same same", "es", None),
        (9, "same same same same same same", "es", "b"),
        (10, "a\u0000b <|endoftext|> '́x   y z", "en", "c"),
    ]
    return [(*r, len(r[1] or ""), "clash", "clash", 1, "clash", "clash") for r in rows]


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
