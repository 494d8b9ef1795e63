"""Column expressions over document content.

`content` arguments are BINARY columns unless they are called `text`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text format.
HEAD_BYTES = 4096  # bytes examined by the binary test
BINARY_PERCENT = 10  # more control bytes than this makes content binary
MAX_BLANK_LINES = 2
NOT_UTF8_TEXT = "Non-UTF8 content"
PREFIX_BYTES = 1000  # bytes covered by the prefix digest
SAMPLE_CHARS = 50
MIDDLE_FROM = 100

# Unicode white space without the line feed.
BLANK_CLASS = (
    r"[ \t\x0B\x0C\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _byte_class(members) -> str:
    """Regex class that lists each byte: the Java engine tests a list by table
    lookup, ranges and negations one at a time."""
    return "[" + "".join(rf"\x{b:02X}" for b in members) + "]"


# Control bytes other than tab, line feed and carriage return.
CONTROL_CLASS = _byte_class(b for b in range(32) if b not in (9, 10, 13))
# Bytes other than printable ASCII, tab, line feed and carriage return.
MASKED_CLASS = _byte_class(b for b in range(256) if not 32 <= b <= 126 and b not in (9, 10, 13))

LF = "\n"


def head_bytes(content: Column) -> Column:
    return F.least(F.octet_length(content), F.lit(HEAD_BYTES))


def control_count(content: Column) -> Column:
    """Control bytes in the head, as its length less the length without them.

    Decoding as ISO-8859-1 gives one character per byte. Most texts hold no
    control byte at all, which one search that replaces nothing shows.
    """
    head = F.substring(content, 1, HEAD_BYTES)
    without = F.regexp_replace(F.decode(head, "ISO-8859-1"), CONTROL_CLASS + "+", "")
    return F.when(
        head.cast("string").rlike(CONTROL_CLASS), head_bytes(content) - F.length(without)
    ).otherwise(F.lit(0))


def is_binary(content: Column) -> Column:
    """More than ten percent (whole percents) control bytes in the head.

    `floor(100 n / size) > 10` for positive integers is `100 n >= 11 size`,
    which needs no division.
    """
    size = head_bytes(content)
    return (size > 0) & (control_count(content) * 100 >= size * (BINARY_PERCENT + 1))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def render_text(content: Column) -> Column:
    """Content as text, or a fixed notice where it is not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.lit(NOT_UTF8_TEXT))


def mask_ascii(content: Column) -> Column:
    """Every byte outside printable ASCII, tab, LF and CR becomes one `?`."""
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), MASKED_CLASS, "?")


def lf_lines(text: Column) -> Column:
    """Line ends as LF."""
    return F.replace(text, F.lit("\r\n"), F.lit(LF))


def end_with_lf(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit(LF)), text).otherwise(F.concat(text, F.lit(LF)))


def without_final_lf(text: Column) -> Column:
    return F.when(
        F.endswith(text, F.lit(LF)), F.substr(text, F.lit(1), F.length(text) - 1)
    ).otherwise(text)


def blank_lines_emptied(text: Column) -> Column:
    """CRLF to LF, then lines of only white space to empty lines."""
    return F.regexp_replace(lf_lines(text), rf"(?md)^{BLANK_CLASS}++$", "")


def squeeze_lines(text: Column, max_blank: int) -> Column:
    """`squeeze` of a text that ends in a line feed.

    One pass: a match starts at a blank line and takes its whole run; the
    groups hold the line feeds that stay.
    """
    line = rf"{BLANK_CLASS}*+\n"
    kept = "".join(rf"(?:{BLANK_CLASS}*+(\n))?" for _ in range(max_blank - 1))
    groups = "".join(f"${i}" for i in range(1, max_blank))
    return F.regexp_replace(
        lf_lines(text),
        rf"(?md)^{line}{kept}(?:{line})*+",
        (LF if max_blank else "") + groups,
    )


def squeeze(text: Column, max_blank: int = MAX_BLANK_LINES) -> Column:
    """Normalise line ends, empty the blank lines, and cut longer blank runs.

    Runs are cut inside one row: a frame begins and ends with a line that is
    not blank, so squeezing each document alone equals squeezing the bundle.
    """
    return squeeze_lines(end_with_lf(text), max_blank)


def canonical_text(content: Column, squeezed: bool = True) -> Column:
    """The body a frame stores: text plus one line feed, squeezed."""
    text = F.concat(render_text(content), F.lit(LF))
    return squeeze_lines(text, MAX_BLANK_LINES) if squeezed else text


def restore_text(body: Column) -> Column:
    """Frame body back to file text: its lines joined by LF, ending in LF.

    A body that already ends in an empty line gives up its own final LF.
    """
    return F.when(F.endswith(body, F.lit(LF + LF)), without_final_lf(body)).otherwise(body)


def roundtrip_text(content: Column) -> Column:
    """What unpacking returns for packed text content."""
    return restore_text(canonical_text(content))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def prefix_digest(content: Column, n_bytes: int = PREFIX_BYTES) -> Column:
    return F.sha2(F.substring(content, 1, n_bytes), 256)


def preview_head(text: Column) -> Column:
    return F.substr(text, F.lit(1), F.lit(SAMPLE_CHARS))


def preview_middle(text: Column) -> Column:
    """Characters [min(100, n - 50), min(150, n)) of the text."""
    n = F.length(text)
    start = F.least(F.lit(MIDDLE_FROM), F.greatest(n - SAMPLE_CHARS, F.lit(0)))
    stop = F.least(F.lit(MIDDLE_FROM + SAMPLE_CHARS), n)
    return F.substr(text, start + 1, stop - start)


def preview_tail(text: Column) -> Column:
    return F.right(text, F.lit(SAMPLE_CHARS))


def blank_runs(text: Column) -> Column:
    """Lengths of all runs of blank lines, as an array.

    A run at the very start is one line per LF; elsewhere the first LF ends the
    line before the run.
    """
    runs = F.regexp_extract_all(
        F.concat(F.lit(LF), blank_lines_emptied(end_with_lf(text))), F.lit(r"\n\n+"), F.lit(0)
    )
    return F.transform(runs, lambda r: F.length(r) - 1)
