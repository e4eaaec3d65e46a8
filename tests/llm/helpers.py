"""Small tables that every operator must survive, and plain versions of what operators compute."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, label string, key string"
LONG = "lorem ipsum dolor " * 60_000


def table(spark, texts, first=0):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(first + i, t, "en", "src1", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, and rows that repeat."""
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", None, 0, None, None, None),
        (3, " \n\t ", "en", "src0", 4, None, None, None),
        (None, "a row without an id but with several words", None, "src0", None, None, None, None),
        (4, LONG, "en", "src0", len(LONG), "r", "l", "k"),
        (5, "the same words in the same order twice over", "en", "src0", 43, "r", "l", "k"),
        (5, "the same words in the same order twice over", "en", "src0", 43, "r", "l", "k"),
        (6, "!!! *** ???", "en", "src0", 11, "r", "l", "k"),
        (7, "x", "en", "src0", 1, "r", "l", "k"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
