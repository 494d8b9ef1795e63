"""Quality rules against a plain version."""

import math
import re
from collections import Counter

import xxhash

from bindery.llm import quality

SCHEMA = "doc_id long, text string, n_words string, tokens int, `a.b` int, kept string, _hash int"
LONG = " ".join(f"w{i % 1000} und" for i in range(20_000))
PHRASE = "one two three four five six seven eight nine ten"
TEXTS = [
    None, "", " \n\t ", "one", PHRASE, f"{PHRASE} {PHRASE}", f"{PHRASE} x {PHRASE} y\n{PHRASE}", "a " * 30,
    "line one\nline one\n\n\nline two\r\nline one\n \n ", "naïve café — 漢字 🙂 #1 $$ <b>&</b>|%", LONG,
    "a b c d e f g h a b c d e f g h a b c d e f g h i", "word joined word two " * 6, "x" * 50_000,
    " ".join(f"clean text number {i} with some words" for i in range(8)),
    " ".join(f"junk&&& te$$xt%%% number### {i}***" for i in range(8)),
]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def bucket_of(token):
    return signed(xxhash.xxh64(token.encode(), seed=42).intdigest()) % quality.BUCKETS


def hash_int(value, seed):
    return xxhash.xxh64(value.to_bytes(4, "little"), seed=seed).intdigest()


def grams(text):
    ones = [bucket_of(t) for t in re.findall(r"[^\W_]+|(?:(?![ \t-\r])[\W_])+", text or "")]
    twos = [quality.BUCKETS + signed(hash_int(b, hash_int(a, 42))) % quality.BUCKETS for a, b in zip(ones, ones[1:])]
    return ones + twos


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def expected(rows, trusted, threshold):
    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(grams(text))
        if i in trusted and i is not None:
            target.update(grams(text))
    ratios = [0] * (2 * quality.BUCKETS)
    if target:
        for start in (0, quality.BUCKETS):
            spans = range(start, start + quality.BUCKETS)
            totals = [math.log(sum(c[b] + 1 for b in spans)) for c in (target, raw)]
            for b in spans:
                logs = [math.log(c[b] + 1) - t for c, t in zip((target, raw), totals)]
                ratios[b] = round(quality.UNIT * (logs[0] - logs[1]))
    out = []
    for i, text in rows:
        own, counts = grams(text), base(text)
        total = sum(ratios[g] for g in own)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        score = total / len(own) / quality.UNIT if own else None
        out.append((i, *counts, failed, len(own), score, not failed and total >= round(threshold * quality.UNIT) * len(own)))
    return out


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(parts)


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_grams score kept".split()


def check(spark, rows, trusted, threshold=quality.THRESHOLD):
    names = spark.createDataFrame([(i, "extra") for i in trusted], "doc_id long, text string")
    found = quality.quality_rules(frame(spark, rows), names, threshold=threshold)
    got = sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=key)
    want = sorted(expected(rows, trusted, threshold), key=key)
    assert [(*r[:8], r[9]) for r in got] == [(*r[:8], r[9]) for r in want]
    for g, w in zip(got, want):
        assert (g[8] is None) == (w[8] is None) and (w[8] is None or abs(g[8] - w[8]) < 1e-12)
    return want


def test_against_plain_version(spark):
    rows = list(enumerate(TEXTS)) + [(3, "one"), (None, PHRASE), (None, None), (14, TEXTS[15])]
    want = check(spark, rows, [10, 14, 14, 12, None])
    verdicts = {r[0]: r[-1] for r in want if r[0] not in (None, 14)}
    assert verdicts[10] is False and verdicts[15] is False  # repeats, and no trusted signs
    check(spark, rows, [10, 14, 12], threshold=0.0)


def test_without_trusted_documents(spark):
    want = check(spark, list(enumerate(TEXTS)), [])
    assert {r[8] for r in want} == {None, 0.0}


def test_empty_table(spark):
    check(spark, [], [1, 2])


def test_repeated_words_cover_overlaps(spark):
    rows = [(1, "a " * 8), (2, "a " * 9), (3, "a " * 16 + "b " * 20), (4, " ".join("abcdefgh" * 2 + "abcdefgz"))]
    check(spark, rows, [1])


def test_no_python_in_the_plan(spark):
    docs = frame(spark, list(enumerate(TEXTS)))
    rows = quality.text_features(docs.select("doc_id", "text"), ["doc_id"])
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
