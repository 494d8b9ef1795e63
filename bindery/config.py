"""Settings of a pack run."""

from __future__ import annotations

from dataclasses import dataclass, field

from bindery.functions.globs import glob_body
from bindery.functions.paths import parse_types

MIB = 1024 * 1024

# Bytes of one shard, which its last file may exceed: as a file, and as a row.
# An aggregating task holds up to 128 rows at a time before Spark sorts instead.
FILE_SHARD_BYTES = 128 * MIB
ROW_SHARD_BYTES = 16 * MIB


@dataclass(frozen=True)
class PackConfig:
    """Admission rules and output form, checked when the object is made.

    `types` takes a comma-separated text or a list; `all_types` overrides it.
    `max_bytes` and `file_cap` of None mean no limit. Raises `GlobError` for a bad pattern.
    """

    include_hidden: bool = False
    recursive: bool = True
    skip_patterns: tuple[str, ...] = ()
    max_bytes: int | None = None
    name_pattern: str | None = None
    types: str | tuple[str, ...] = ()
    all_types: bool = False
    file_cap: int | None = None
    squeeze: bool = True
    signed: bool = False
    key: bytes | None = field(default=None, repr=False)
    shard_bytes: int = FILE_SHARD_BYTES

    def __post_init__(self):
        for pattern in (*self.skip_patterns, *filter(None, [self.name_pattern])):
            glob_body(pattern)
        if (self.max_bytes or 0) < 0 or self.shard_bytes < 1:
            raise ValueError("max_bytes must not be negative and shard_bytes must be positive")

    @property
    def extensions(self) -> list[str]:
        return [] if self.all_types else parse_types(self.types)
