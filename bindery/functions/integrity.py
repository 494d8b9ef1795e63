"""Content digests, plain and keyed, as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HMAC with SHA-256.
HMAC_BLOCK = 64
INNER_PAD, OUTER_PAD = 0x36, 0x5C
DIGEST_BYTES = 32


def _pad(key: bytes, fill: int) -> Column:
    short = hashlib.sha256(key).digest() if len(key) > HMAC_BLOCK else key
    return F.lit(bytes(b ^ fill for b in short.ljust(HMAC_BLOCK, b"\0")))


def keyed_digest(content: Column, key: bytes) -> Column:
    """HMAC-SHA256 as hex, from built-in functions; pads are made on the driver."""
    inner = F.sha2(F.concat(_pad(key, INNER_PAD), content.cast("binary")), 256)
    return F.sha2(F.concat(_pad(key, OUTER_PAD), F.unhex(inner)), 256)


def content_digest(content: Column, key: bytes | None = None) -> Column:
    return F.sha2(content.cast("binary"), 256) if key is None else keyed_digest(content, key)


def signature(body: Column, key: bytes | None = None) -> Column:
    """Digest in the form a frame header carries."""
    return F.base64(F.unhex(content_digest(body, key)))


def is_digest(encoded: Column) -> Column:
    """Base64 text of exactly one digest."""
    return F.coalesce(
        F.octet_length(F.try_to_binary(encoded, F.lit("base64"))) == DIGEST_BYTES, F.lit(False)
    )
