"""The framed text form of a document, written and parsed as columns.

A text frame is a header line, the body, a fence line and an empty line. A
binary frame is a header line and one marker line, with no fence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions import text as T

# Fixed values of the frame format.
HEADER_PREFIX = "'''--- "
HEADER_SUFFIX = " ---"
SIGNATURE_OPEN = " --- [SIGNATURE:"
SIGNATURE_CLOSE = "]"
KEY_PATH = "PUBLIC_KEY"
KEY_OPEN = "PUBLIC_KEY --- [KEY:"
KEY_BYTES = 32
FENCE = "'''"
BINARY_MARKER = "[Binary file - contents omitted]"

LF = T.LF
FRAME_BREAK = LF + HEADER_PREFIX
FENCE_LINE = LF + FENCE + LF
# Bytes a frame adds to a path and a body (header, fence, line ends), rounded up.
FRAME_OVERHEAD = 24


def header_line(path: Column, signature: Column | None = None) -> Column:
    plain = F.concat(F.lit(HEADER_PREFIX), path, F.lit(HEADER_SUFFIX))
    if signature is None:
        return F.concat(plain, F.lit(LF))
    signed = F.when(
        signature.isNotNull(),
        F.concat(F.lit(" [SIGNATURE:"), signature, F.lit(SIGNATURE_CLOSE)),
    ).otherwise(F.lit(""))
    return F.concat(plain, signed, F.lit(LF))


def render_frame(
    path: Column, body: Column, binary: Column, signature: Column | None = None
) -> Column:
    """Frame text; `body` is the canonical text and is ignored for binary rows."""
    return F.when(
        binary, F.concat(header_line(path), F.lit(BINARY_MARKER + LF))
    ).otherwise(F.concat(header_line(path, signature), body, F.lit(FENCE + LF + LF)))


def key_block(key_base64: Column) -> Column:
    """Block that carries a bundle's public key, placed before its frames."""
    return F.concat(F.lit(HEADER_PREFIX + KEY_OPEN), key_base64, F.lit("]" + FENCE_LINE + LF))


def _trimmed(header: Column) -> Column:
    return F.regexp_replace(header, rf"{T.BLANK_CLASS}+$", "")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{T.BLANK_CLASS}+|{T.BLANK_CLASS}+$", "")


def header_signature(header: Column) -> Column:
    """Signature of a header (given without its prefix), or null."""
    h = _trimmed(header)
    inner = F.substring_index(h, SIGNATURE_OPEN, -1)
    return F.when(
        F.contains(h, F.lit(SIGNATURE_OPEN)) & F.endswith(h, F.lit(SIGNATURE_CLOSE)),
        F.substr(inner, F.lit(1), F.length(inner) - 1),
    )


def header_path(header: Column) -> Column:
    """Path of a header (given without its prefix); null when malformed.

    The last signature mark counts, so a path may itself contain ` --- `.
    """
    h = _trimmed(header)
    signed = F.contains(h, F.lit(SIGNATURE_OPEN))
    tail = F.substring_index(h, SIGNATURE_OPEN, -1)
    return F.when(
        signed & F.endswith(h, F.lit(SIGNATURE_CLOSE)),
        _stripped(
            F.substr(h, F.lit(1), F.length(h) - F.length(tail) - F.lit(len(SIGNATURE_OPEN)))
        ),
    ).when(
        ~signed & F.endswith(h, F.lit(HEADER_SUFFIX)),
        _stripped(F.substr(h, F.lit(1), F.length(h) - len(HEADER_SUFFIX))),
    )


def is_key_header(header: Column) -> Column:
    return F.startswith(header, F.lit(KEY_OPEN)) & F.endswith(_trimmed(header), F.lit("]"))


def path_survives(path: Column) -> Column:
    """Is the path read back as it is from a plain and from a signed header? False for null."""
    plain = F.substring_index(F.concat(path, F.lit(HEADER_SUFFIX)), LF, 1)
    signed = F.substring_index(F.concat(path, F.lit(SIGNATURE_OPEN + "x" + SIGNATURE_CLOSE)), LF, 1)
    read = (header_path(plain) == path) & (header_path(signed) == path) & ~is_key_header(signed)
    return F.coalesce(read, F.lit(False))


def header_key(header: Column) -> Column:
    """Key text of a key header."""
    h = _trimmed(header)
    return F.substr(h, F.lit(len(KEY_OPEN) + 1), F.length(h) - len(KEY_OPEN) - 1)


# A record is the text between two header prefixes. Its header and its second
# line are found without going through the rest, so that filters on them stay
# cheap wherever the optimizer moves them.


def record_header(record: Column) -> Column:
    return F.substring_index(record, LF, 1)


def record_is_binary(record: Column) -> Column:
    second = F.substring_index(F.substring_index(record, LF, 2), LF, -1)
    return second.isin(BINARY_MARKER, BINARY_MARKER + "\r")


def record_body(record: Column) -> Column:
    """Lines before the first fence line, each ended by LF; '' for none.

    A fence is added after the record, so that one is always found, and the
    text is searched from the line feed of the header on.
    """
    tail = F.substr(record, F.length(record_header(record)) + 1)
    fenced = T.lf_lines(F.concat(tail, F.lit(FENCE_LINE)))
    lines = F.substring_index(fenced, FENCE_LINE, 1)
    return F.substr(F.concat(lines, F.lit(LF)), F.lit(2))


def collides(body: Column) -> Column:
    """True when a text body holds a line the parser would take as a marker."""
    lined = F.concat(F.lit(LF), body)
    return (
        F.contains(lined, F.lit(FENCE_LINE))
        | F.contains(lined, F.lit(FRAME_BREAK))
        | F.startswith(body, F.lit(BINARY_MARKER + LF))
    )
