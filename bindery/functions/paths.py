"""Column expressions over path strings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ways a remote repository address may begin.
REPO_URL_PATTERN = r"^(https?://|git://|ssh://|git@)"

# Absolute paths, parent-directory components, blank paths and NUL characters.
UNSAFE_PATH_PATTERN = r"^/|(^|/)\.\.(/|$)|^\s*$|\x00"


def base_name(path: Column) -> Column:
    """Last component of a slash-separated path."""
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last slash; empty when there is none."""
    return F.when(
        F.contains(path, F.lit("/")),
        F.substr(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1),
    ).otherwise(F.lit(""))


def extension(name: Column) -> Column:
    """Last dotted suffix of a base name, case kept; '' when the only dot leads.

    `a.tar.gz` gives `.gz`, `a.` gives `.`, `.bashrc` gives ''.
    """
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)


def parse_types(types: str | Iterable[str]) -> list[str]:
    """Normalise an extension list: trim, drop blanks, add the dot, dedupe."""
    parts = types.split(",") if isinstance(types, str) else types
    named = (p.strip() for p in parts)
    return sorted({p if p.startswith(".") else "." + p for p in named if p})


def type_list(types: Column) -> Column:
    """Column form of `parse_types`: comma-separated text to a sorted array."""
    trimmed = F.transform(F.split(types, ","), lambda p: F.trim(p))
    dotted = F.transform(
        F.filter(trimmed, lambda p: p != ""),
        lambda p: F.when(p.startswith("."), p).otherwise(F.concat(F.lit("."), p)),
    )
    return F.array_sort(F.array_distinct(dotted))


def in_hidden_tree(relative: Column) -> Column:
    """True when any component of a root-relative path begins with a dot."""
    return F.startswith(relative, F.lit(".")) | F.contains(relative, F.lit("/."))


def is_repo_url(text: Column) -> Column:
    return text.rlike(REPO_URL_PATTERN)


def repo_name(url: Column) -> Column:
    """Repository name of a clone address, without any trailing `.git`."""
    scp_form = r"^git@[^:]*:(?:[^:]*/)?([^/:]*)(?::.*)?$"
    last = F.when(url.rlike(scp_form), F.regexp_extract(url, scp_form, 1)).otherwise(
        F.substring_index(url, "/", -1)
    )
    return F.regexp_replace(last, r"(\.git)+$", "")


def is_safe_path(path: Column) -> Column:
    """True for a relative path that stays under the directory it is joined to."""
    return path.isNotNull() & ~path.rlike(UNSAFE_PATH_PATTERN)


def names_file(path: Column) -> Column:
    """False for a path that can only be a folder: its last component is empty or a dot."""
    return path.isNotNull() & ~path.rlike(r"(^|/)\.?\z")


def tidy_path(path: Column) -> Column:
    """A relative path without empty and `.` components."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.array_join(parts, "/")


def relative_path(path: Column, prefix: str) -> Column:
    """Drop a leading prefix where present."""
    if not prefix:
        return path
    return F.when(
        F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))
    ).otherwise(path)


def bundle_name(name: Column, epoch: Column) -> Column:
    """`<name>_<epoch>.txt`; the epoch is an input so that runs repeat exactly."""
    return F.concat(name, F.lit("_"), epoch.cast("string"), F.lit(".txt"))
