"""Plain restatements that the operators are held against."""

from __future__ import annotations

import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
#: Nulls, empty and long texts, repeated rows, ties, odd letters.
ODD = [
    (1, "Hello There big World\nsecond line here\nÉTÉ line is Long enough\n\nx", "en", "s", 3),
    (2, "hello there BIG world\nown line number two\nété line is long enough", "en", "s", 3),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, LONG, "en", "s", None),
    (5, LONG, "en", "s", None),
    (6, " \t\n\x0b \n", "fr", "s", 1),
    (None, "hello there big world\nunowned words stand here", "de", "s", 1),
    (7, "ß漢字 \U0001f600 e\u0301 don't we'll I'VE 'tis 12³ \u00a0\u2003 x", "xx", "s", 1),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return text.translate(_LOWER)


def words(text):
    return WORD.findall(text or "")
