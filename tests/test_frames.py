from pyspark.sql import functions as F

import model
from bindery.functions import frames

X = F.col("x")


def test_header_lines(evaluate):
    assert evaluate(frames.header_line(X), ["a/b.c"]) == ["'''--- a/b.c ---\n"]
    assert evaluate(frames.header_line(X, F.lit("c2ln")), ["a"]) == [
        "'''--- a --- [SIGNATURE:c2ln]\n"
    ]
    assert evaluate(frames.header_line(X, F.lit(None).cast("string")), ["a"]) == [
        "'''--- a ---\n"
    ]
    assert evaluate(frames.key_block(X), ["QUJD"]) == [
        "'''--- PUBLIC_KEY --- [KEY:QUJD]\n'''\n\n"
    ]


def test_frames(evaluate):
    text = frames.render_frame(F.lit("p"), X, F.lit(False))
    assert evaluate(text, ["abc\n"]) == ["'''--- p ---\nabc\n'''\n\n"]
    binary = frames.render_frame(F.lit("p"), X, F.lit(True), F.lit("never signed"))
    assert evaluate(binary, [None]) == ["'''--- p ---\n[Binary file - contents omitted]\n"]


def test_header_parse(evaluate):
    cases = {
        "a ---": ("a", None),
        "a --- b ---": ("a --- b", None),
        "a --- [SIGNATURE:xy=]": ("a", "xy="),
        "a --- [SIGNATURE:x] --- [SIGNATURE:y]": ("a --- [SIGNATURE:x]", "y"),
        "a --- [SIGNATURE:x ---": (None, None),
        "a --- [SIGNATURE:x": (None, None),
        "  a  ---  ": ("a", None),
        "a": (None, None),
        "a]": (None, None),
        "a ---\r": ("a", None),
        " ---": ("", None),
    }
    assert evaluate(frames.header_path(X), list(cases)) == [p for p, _ in cases.values()]
    assert evaluate(frames.header_signature(X), list(cases)) == [s for _, s in cases.values()]


def test_body(evaluate):
    cases = {
        "h": "", "h\n'''": "", "h\n'''\n": "", "h\na\n'''\n": "a\n", "h\n\n'''\n": "\n",
        "h\na\n'''\nrest\n'''": "a\n", "h\na": "a\n", "h\n''' \nb\n'''": "''' \nb\n",
        "h\nx'''\n'''": "x'''\n", "h\na\n\n\n'''\n": "a\n\n\n",
    }
    assert evaluate(frames.record_body(X), list(cases)) == list(cases.values())
    marked = {f"h\n{model.MARKER}": True, f"h\n{model.MARKER}\r\nx": True, "h\nx": False,
              f"h\nx\n{model.MARKER}": False, "h": False, "h\n": False}
    assert evaluate(frames.record_is_binary(X), list(marked)) == list(marked.values())


def test_collides(evaluate):
    cases = {
        "a\n": False, "'''\n": True, "a\n'''\n": True, "a'''\n": False, "''' \n": False,
        "'''--- x\n": True, " '''--- x\n": False, "'''---x\n": False,
        model.MARKER + "\n": True, "a\n" + model.MARKER + "\n": False, model.MARKER + "x\n": False,
    }
    assert evaluate(frames.collides(X), list(cases)) == list(cases.values())
