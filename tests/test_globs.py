import re

import pytest
from pyspark.sql import functions as F

from bindery.functions import globs

X = F.col("x")

CASES = [
    ("*", "a/b", True), ("[!a]", "b", True), ("[!a]", "a", False), ("*.c", "x.c", True),
    ("*.c", "x.C", False), ("*.c", "x.cc", False), ("a?c", "abc", True), ("a?c", "a/c", True),
    ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[a-c]x", "dx", False), ("[c-a]x", "bx", False),
    ("[]]", "]", True), ("[!]]", "a", True), ("[!]]", "]", False), ("[-a]", "-", True),
    ("**", "a/b/c", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("**/x", "ax", False),
    ("a/**/b", "a/b", True), ("a/**/b", "a/c/d/b", True), ("a/**/b", "ab", False),
    ("a/**", "a/b/c", True), ("a/**", "a", False), ("**/**/x", "a/x", True), ("", "", True),
    ("", "a", False), ("a.c", "abc", False), ("a+(b)|c", "a+(b)|c", True), ("{a,b}", "a", False),
    ("{a,b}", "{a,b}", True), ("a\\*", "a\\bc", True), ("*a*", "xax", True), ("a*", "ba", False),
    ("test*.c", "test1.c", True), ("*", "line\nbreak", True), ("*.gz", ".gz", True),
    ("[a^]", "^", True), ("[a&&b]", "&", True), ("é?", "éb", True), ("?", "\U0001F600", True),
]


def test_matching(evaluate):
    for pattern in dict.fromkeys(p for p, _, _ in CASES):
        rows = [(t, e) for p, t, e in CASES if p == pattern]
        got = evaluate(globs.matches_glob(X, pattern), [t for t, _ in rows])
        assert got == [e for _, e in rows], pattern
        as_regex = evaluate(X.rlike(globs.glob_to_regex(pattern)), [t for t, _ in rows])
        assert as_regex == [e for _, e in rows], pattern


def test_any_of(evaluate):
    patterns = ["*.c", "a*", "[0-9]x", "?y"]
    texts = ["m.c", "ab", "1x", "zy", "none", "bx"]
    got = evaluate(globs.matches_any_glob(X, patterns), texts)
    assert got == [True, True, True, True, False, False]
    assert evaluate(globs.matches_any_glob(X, []), ["a"]) == [False]


@pytest.mark.parametrize("pattern", ["[", "a[b", "a**b", "***", "a/**b", "[!]", "[]"])
def test_bad_pattern(pattern):
    with pytest.raises(globs.GlobError):
        globs.glob_to_regex(pattern)


def test_every_match_contains_its_key():
    for pattern, text, expected in CASES:
        if expected:
            assert globs.literal_key(pattern) in text, pattern
    assert globs.literal_key("*doc_123.*") == "doc_123."
    assert globs.literal_key("*") == ""
    assert re.fullmatch("[a-z]+", globs.literal_key("*abc?"))


def test_simple_shapes_avoid_regex(spark):
    plan = spark.range(1).select(F.lit("a").alias("x")).filter(
        globs.matches_any_glob(X, ["*.c", "a*", "*b*", "k"])
    )._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" not in plan
