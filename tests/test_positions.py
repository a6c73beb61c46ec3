"""Positions of all characters of long and odd texts."""

import time

import regex

from scopeloom.functions import positions as pos


def offsets(t):
    starts = {m.start() for m in regex.finditer(r"\X", t)}
    return [(i, len(t[:i].encode()), len(t[:i].encode("utf-16-be")) // 2, sum(s < i for s in starts)) for i in range(len(t) + 1)]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in pos.all_chars(df, "k", "t").collect():
        got.setdefault(r.k, []).append((r.i, r.utf8, r.utf16, r.grapheme))
    return {k: sorted(v) for k, v in got.items()}


def test_all_chars(spark):
    texts = ["", "abc", "a\r\nb", "a\rb\n", "éx", "e\u0301x", "\U0001f1e9\U0001f1eay", "中文字", "\u1100\u1161\u11a8한", "a\u200cb", "가\u11a8", "\U0001f468\u200d\U0001f469!", "Привет, мир", "\u0600a"]
    assert found(spark, [*texts, None]) == {k: offsets(t) for k, t in enumerate(texts)}


def test_all_chars_of_a_long_line(spark):
    """Work grows with the length of a line, not with its square: 120,000 characters take seconds."""
    at = time.time()
    df = spark.createDataFrame([(0, "é" * 120_000), (1, "a" * 120_000)], "k int, t string")
    r = pos.all_chars(df, "k", "t").groupBy("k").agg({"utf8": "max", "utf16": "max", "grapheme": "max", "i": "count"}).orderBy("k").collect()
    assert [(x["max(utf8)"], x["max(utf16)"], x["max(grapheme)"], x["count(i)"]) for x in r] == [(240_000, 120_000, 120_000, 120_001), (120_000, 120_000, 120_000, 120_001)]
    assert time.time() - at < 30
