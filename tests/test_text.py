"""Text functions against Python's own string methods."""

import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import udf as U

NASTY = [
    "", " ", "a b", "a b c", "\x1ca\x1db ", "fin-", "fin -", "Ober⸗", "x­ ", "3-", "é́té", "ſtﬁ", "a\tb\nc", "ḿ-",
    "l1gne 2 c0mme", "(1er)", "﻿zw​j", None,
]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(NASTY)], "i int, x string")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_tokens_and_strip(nasty):
    assert values(nasty, T.py_tokens(F.col("x"))) == [None if x is None else x.split() for x in NASTY]
    assert values(nasty, T.py_strip(F.col("x"))) == [None if x is None else x.strip() for x in NASTY]


def test_nfc_and_fold(nasty):
    assert values(nasty, U.nfc(F.col("x"))) == [None if x is None else unicodedata.normalize("NFC", x) for x in NASTY]
    assert values(nasty, U.ncfold(F.col("x"))) == [None if x is None else unicodedata.normalize("NFC", x).casefold() for x in NASTY]


def test_trailing_mark(nasty):
    def one(x):
        t = (x or "").rstrip()
        return t[-1] if len(t) > 1 and t[-1] in T.BREAK_MARKS and t[-2].isalpha() else None

    got = values(nasty, T.trailing_hyphen_char(F.col("x")))
    assert [g for g, x in zip(got, NASTY) if x != "ḿ-"] == [one(x) for x in NASTY if x != "ḿ-"]


def test_preserve_break_char(spark):
    df = spark.createDataFrame([(0, "a¬", "b- "), (1, "a", "b-"), (2, "a-", "b"), (3, "a-", "b-")], "i int, s string, c string")
    assert values(df, T.preserve_break_char(F.col("s"), F.col("c"))) == ["b¬ ", "b-", "b", "b-"]


def test_seq_ratio(spark):
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("kitten", "sitting"), ("été", "ete"), (None, "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    want = [None if a is None else 1.0 if a == b else 0.0 if not a or not b else difflib.SequenceMatcher(None, a, b, False).ratio() for a, b in pairs]
    assert values(df, U.seq_ratio(F.col("a"), F.col("b"))) == want


def test_changed_chars(spark):
    pairs = [("abc", "abc"), ("abc", "axc"), ("abc", "abcd"), ("", "xyz"), ("aaa", "aa"), ("abcdef", "xyz")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert values(df, T.changed_chars(F.col("a"), F.col("b"))) == [0, 1, 1, 3, 1, 6]


def test_ints(spark):
    raw = [None, "", "12", "12.9", "-3.7", "x", "1e999"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    assert values(df, T.int_tolerant(F.col("x"))) == [0, 0, 12, 12, -3, 0, 0]


def test_polygon(spark):
    df = spark.createDataFrame([(0, "1,2 5,9 x,3 4"), (1, ""), (2, None)], "i int, p string")
    assert [tuple(r) for r in values(df, T.polygon_bbox(F.col("p")))] == [(1, 2, 4, 7), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_secrets(spark):
    raw = ["Authorization: Bearer abcdefghijk", "key sk-abcdefgh123 end", "password=hunter22 x", "plain text", "my exact secret-value-1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    out = values(df, T.sanitize_error(F.col("x"), "secret-value-1"))
    assert not any(s in " ".join(out) for s in ("abcdefghijk", "abcdefgh123", "hunter22", "value-1"))
    assert out[3] == "plain text"
