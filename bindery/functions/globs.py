"""Shell-style globs compiled on the driver to Spark predicates.

`*` matches any run including `/`, `?` one character, `[abc]` / `[a-z]` /
`[!abc]` one character of (or outside) a class, `**` any number of whole path
components. There is no brace form and no escape character, matching is case
sensitive and covers the whole string. A bad pattern raises `GlobError` while
the plan is built, before any job starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\*+|\?|\[![\s\S][^\]]*\]|\[[^!][^\]]*\]|[^*?\[]+|\[")
_RANGE_OR_CHAR = re.compile(r"([\s\S])-([\s\S])|([\s\S])")
_REGEX_SPECIAL = re.compile(r"([\\.^$|()\[\]{}*+?&~#\-])")


class GlobError(ValueError):
    """The pattern is not a valid glob."""


def _quote(text: str) -> str:
    return _REGEX_SPECIAL.sub(r"\\\1", text)


def _char_class(body: str, negated: bool) -> str:
    members = []
    for low, high, single in _RANGE_OR_CHAR.findall(body):
        if single:
            members.append(_quote(single))
        elif low <= high:
            members.append(f"{_quote(low)}-{_quote(high)}")
    if not members:  # only reversed ranges, which hold no character
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(members)}]"


def glob_body(pattern: str) -> str:
    """Unanchored regex body, valid in Java and in RE2 alike."""
    out: list[str] = []
    tokens = _TOKEN.findall(pattern)
    for i, token in enumerate(tokens):
        if token[0] == "*" and len(token) == 1:
            out.append(".*")
        elif token[0] == "*":
            before = tokens[i - 1] if i else "/"
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            if len(token) > 2 or before[-1] != "/" or (after and after[0] != "/"):
                raise GlobError(f"'**' must be a whole path component: {pattern!r}")
            if after is None or (after == "/" and i + 2 == len(tokens)):
                out.append(".*")
            else:
                out.append("(?:.*/)?")
        elif token == "?":
            out.append(".")
        elif token == "[":
            raise GlobError(f"unclosed character class: {pattern!r}")
        elif token[0] == "[":
            negated = token[1] == "!"
            out.append(_char_class(token[2:-1] if negated else token[1:-1], negated))
        else:
            follows_recursive = i > 0 and len(tokens[i - 1]) > 1 and tokens[i - 1][0] == "*"
            out.append(_quote(token[1:] if follows_recursive else token))
    return "".join(out)


def glob_to_regex(pattern: str) -> str:
    """Whole-string regex for `rlike`."""
    return rf"(?s)\A(?:{glob_body(pattern)})\z"


def matches_glob(text: Column, pattern: str) -> Column:
    """Predicate for one glob; the simple shapes become comparisons that are
    cheaper than a regex and that Parquet scans can evaluate from statistics."""
    glob_body(pattern)  # validates
    core = pattern.strip("*")
    if "**" not in pattern and not re.search(r"[*?\[]", core):
        head, tail = pattern[:1] == "*", pattern[-1:] == "*"
        if not head and not tail:
            return text == F.lit(pattern)
        if not core:
            return text.isNotNull()
        if head and tail:
            return F.contains(text, F.lit(core))
        return F.endswith(text, F.lit(core)) if head else F.startswith(text, F.lit(core))
    return text.rlike(glob_to_regex(pattern))


def _is_simple(pattern: str) -> bool:
    return "**" not in pattern and not re.search(r"[*?\[]", pattern.strip("*"))


def matches_any_glob(text: Column, patterns: Iterable[str]) -> Column:
    """OR over globs: simple shapes one by one, all others as one alternation."""
    patterns = list(dict.fromkeys(patterns))
    if not patterns:
        return F.lit(False)
    tests = [matches_glob(text, p) for p in patterns if _is_simple(p)]
    bodies = [glob_body(p) for p in patterns if not _is_simple(p)]
    if bodies:
        tests.append(text.rlike(rf"(?s)\A(?:{'|'.join(bodies)})\z"))
    return reduce(lambda a, b: a | b, tests)


# Lengths of the text fragments a large pattern table is looked up by.
KEY_WIDTHS = (16, 12, 8, 6, 5, 4, 3, 2, 1)
FRAGMENT_WIDTHS = (12, 6, 3, 2, 1)


def literal_runs(pattern: str) -> list[str]:
    """The literal texts that every text the glob matches contains."""
    runs, previous = [], ""
    for token in _TOKEN.findall(pattern):
        if token[0] not in "*?[":
            runs.append(token[1:] if previous == "**" else token)
        previous = token
    return [run for run in runs if run]


def literal_key(pattern: str) -> str:
    """A fragment that every text the glob matches contains.

    It is the start of the longest literal run, cut to one of `KEY_WIDTHS`; ''
    for a glob without literals.
    """
    longest = max(literal_runs(pattern), key=len, default="")
    return longest[: next((w for w in KEY_WIDTHS if w <= len(longest)), 0)]


def literal_fragments(pattern: str) -> list[str]:
    """Every fragment of the literal runs, of the greatest of `FRAGMENT_WIDTHS` that one
    of them holds; none for a glob without literals. A text that the glob matches
    contains them all.
    """
    runs = literal_runs(pattern)
    longest = max(map(len, runs), default=0)
    width = next((w for w in FRAGMENT_WIDTHS if w <= longest), None)
    if width is None:
        return []
    return sorted({run[i : i + width] for run in runs for i in range(len(run) - width + 1)})


def narrow_fragments(pattern: str) -> list[str]:
    """Fragments of the literal runs too short for `literal_fragments`: each run's, of the
    greatest of `KEY_WIDTHS` that it holds.
    """
    width = max(map(len, literal_fragments(pattern)), default=0)
    found = set()
    for run in literal_runs(pattern):
        if len(run) < width:
            own = next(w for w in KEY_WIDTHS if w <= len(run))
            found |= {run[i : i + own] for i in range(len(run) - own + 1)}
    return sorted(found)
