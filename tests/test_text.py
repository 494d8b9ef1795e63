import random

from pyspark.sql import functions as F

import model
from bindery.functions import text

X = F.col("x")


def random_texts(n=1500, seed=7):
    rng = random.Random(seed)
    pieces = ["a", "b c", "\n", "\n", "\n", "\r\n", "\r", " ", "\t", "\x0b", "\x0c", " ",
              " ", " ", "　", "\x85", "'''", "é", "日本", "\x1c", "\U0001F600"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(n)]


FIXED = ["", "\n", "\n\n\n\n", "a", "a\n", "a\n\n\n\n\nb", " \n \n \nb", "a\r\n\r\n\r\n\r\nb\r\n",
         "a\n\n\nb\n", "\n\n\na", "a\n\n\n\n", "a\r", "\r\r\n", "   ", "a\n   \n\t\nb"]


def test_squeeze_matches_line_model(evaluate):
    texts = FIXED + random_texts()
    # The empty text alone differs: it gains the line feed every text must end in.
    expected = [model.squeeze(t if t else "\n") for t in texts]
    assert evaluate(text.squeeze(X), texts) == expected


def test_squeeze_other_limits(evaluate):
    texts = [t for t in FIXED + random_texts(300) if t]
    for limit in (1, 3):
        assert evaluate(text.squeeze(X, limit), texts) == [model.squeeze(t, limit) for t in texts]


def test_squeeze_is_idempotent(evaluate):
    """But for a double CR at a line end, which loses one CR a pass."""
    texts = [t for t in FIXED + random_texts(300, seed=3) if "\r\r" not in t]
    once = evaluate(text.squeeze(X), texts)
    assert evaluate(text.squeeze(X), once) == once


def test_blank_runs(evaluate):
    texts = [t for t in FIXED + random_texts() if t]
    assert evaluate(text.blank_runs(X), texts) == [model.blank_runs(t) for t in texts]


def test_binary_boundaries(evaluate):
    cases = {
        b"": False,
        b"\x01" * 10 + b"a" * 90: False,
        b"\x01" * 11 + b"a" * 89: True,
        b"a" * 4096 + b"\0" * 5000: False,
        b"\xff\xfea": False,
        b"\0": True,
        b"\n\r\t" * 50: False,
        b"\x1b" * 450 + b"a" * 3646: False,
        b"\x1b" * 451 + b"a" * 3645: True,
    }
    assert evaluate(text.is_binary(X), list(cases), "binary") == list(cases.values())


def test_binary_on_random_bytes(evaluate):
    rng = random.Random(1)
    blobs = []
    for _ in range(800):
        share = rng.choice([0, 0.02, 0.1, 0.11, 0.12, 0.5])
        size = rng.choice([1, 7, 99, 100, 101, 4095, 4096, 4097, 6000])
        blobs.append(bytes(
            rng.choice(b"\x00\x01\x1f\x0b") if rng.random() < share
            else rng.choice(b"ab\n\t\r\xc3\xa9\xe2\xf0\x80\xff") for _ in range(size)
        ))
    assert evaluate(text.is_binary(X), blobs, "binary") == [model.is_binary(b) for b in blobs]
    counts = [sum(c < 32 and c not in (9, 10, 13) for c in b[:4096]) for b in blobs]
    assert evaluate(text.control_count(X), blobs, "binary") == counts


def test_text_of_bytes(evaluate):
    blobs = [b"", b"abc", "é日".encode(), b"\xff\xfea", b"\xc3", b"\xed\xa0\x80"]
    assert evaluate(text.render_text(X), blobs, "binary") == [model.text_of(b) for b in blobs]


def test_mask_ascii(evaluate):
    blobs = ["aé\n\t\r~ ".encode(), bytes(range(256))]
    expected = [
        "".join(chr(c) if 32 <= c <= 126 or c in (9, 10, 13) else "?" for c in b) for b in blobs
    ]
    assert evaluate(text.mask_ascii(X), blobs, "binary") == expected


def test_roundtrip_text(evaluate):
    blobs = {b"": "\n", b"abc": "abc\n", b"abc\n": "abc\n", b"abc\n\n": "abc\n\n",
             b"a\n\n\n\n\nb": "a\n\n\nb\n"}
    assert evaluate(text.roundtrip_text(X), list(blobs), "binary") == list(blobs.values())


def test_restore_text(evaluate):
    bodies = {"": "", "\n": "\n", "a\n": "a\n", "a\n\n": "a\n"}
    assert evaluate(text.restore_text(X), list(bodies)) == list(bodies.values())


def test_preview(evaluate):
    texts = ["", "ab", "x" * 49, "".join(chr(97 + i % 26) for i in range(120)), "y" * 400]

    def middle(t):
        return t[min(100, max(len(t) - 50, 0)) : min(150, len(t))]

    assert evaluate(text.preview_head(X), texts) == [t[:50] for t in texts]
    assert evaluate(text.preview_middle(X), texts) == [middle(t) for t in texts]
    assert evaluate(text.preview_tail(X), texts) == [t[-50:] for t in texts]
