"""Secrets in texts: known shapes, and stretches of high entropy.

Candidates are runs of characters as keys have them. A window slides over each; the
counts of its characters change by one in and one out per step, so its Shannon
entropy is kept up to date in constant time. Windows are judged by the class of
their characters, since ten digits cannot reach the entropy that 64 characters can.
Neighbouring hot windows join to one span. Candidates that an allow-list pattern covers
are left out; of one that begins with an allowed date the rest is judged. Spans of known
shapes always stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import free_name, map_in_arrow

#: The known shapes, whose spans are reported as they match.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
WINDOW = 20
#: Bits a character: the least entropy of a window, by what it is made of. Windows of
#: one case of letters alone are words and not judged.
THRESHOLDS = {"digits": 3.1, "hex": 3.0, "mixed": 3.8}
#: A date, or a date and time, and nothing after it.
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9]{2}(?:-?[0-9]{2}){0,2}(?:-?[0-9]{3,9})?Z?)?"
_DATED = re.compile(f"{DATE}(?![A-Za-z0-9])")
#: No secrets: UUIDs, dates and times, paths and names joined of words.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    DATE,
    r"/?(?:[A-Za-z]+[/_-])+[A-Za-z]*[0-9]{0,4}",
    r"[0-9]+(?:[-/][0-9]+)*",
)

SPANS = "array<struct<kind: string, start: int, stop: int>>"


def _class(window: Counter) -> str | None:
    seen = "".join(window)
    if seen.isdigit():
        return "digits"
    if not any(c.isdigit() for c in seen):
        return "mixed" if seen.lower() != seen != seen.upper() else None
    return "hex" if all(c in "0123456789abcdefABCDEF" for c in seen) else "mixed"


def hot_windows(text: str, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Stretches of `text` that windows over their class's threshold cover."""
    logs = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts, held = Counter(text[:window]), 0.0
    held = sum(logs[n] for n in counts.values())
    start = stop = -1
    for i in range(len(text) - window + 1):
        if i:
            gone, new = text[i - 1], text[i + window - 1]
            held += logs[counts[gone] - 1] - logs[counts[gone]]
            counts[gone] -= 1
            if not counts[gone]:
                del counts[gone]
            held += logs[counts[new] + 1] - logs[counts[new]]
            counts[new] += 1
        kind = _class(counts)
        if kind and math.log2(window) - held / window >= THRESHOLDS[kind]:
            if i > stop:
                if start >= 0:
                    yield start, stop
                start = i
            stop = i + window
    if start >= 0:
        yield start, stop


def find_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, stop) of all secrets of one text, in that order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if word.isalpha() and (word[1:].islower() or word.isupper()):
            continue
        if allowed.fullmatch(word):
            continue
        at, date = m.start(), _DATED.match(word)
        if date and allowed.fullmatch(date[0]):  # covers itself alone
            rest = word[date.end() :]
            if len(rest) < WINDOW or allowed.fullmatch(rest.lstrip("-_/")):
                continue
            at, word = at + date.end(), rest
        found += [(at + a, 3, at + b) for a, b in hot_windows(word)]
    return sorted(found)


#: The long ones among the leftmost longest runs of `HEX`.
LONG_HEX = re.compile(HEX.pattern[:-1] + "{24,}")


def mask_spans(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, done = [], 0
    for start, _, stop in spans:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, stop)
    return "".join([*out, text[done:]])


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    spans: str = "spans",
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """`docs` with `spans`: the kind and code points (stop exclusive) of each secret.

    Spans are sorted by start, then by kind in the order of `KINDS`; spans of several
    kinds may overlap. A null or empty text has none. Rows stay as they are, repeated
    ones too; an empty table stays empty. Where `docs` has a column of the name `spans`, the
    new one is longer by underscores. Texts, however long, are scanned whole, one at a time.
    """
    spans = free_name(spans, docs.columns)
    place, added = docs.columns.index(text), spans

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{a})" for a in allowed) or r"(?!)")
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        )
        for batch in batches:
            found = [
                [(KINDS[k], a, b) for a, k, b in find_spans(t.as_py() or "", allow)]
                for t in batch.column(place)
            ]
            rows = [[dict(zip(("kind", "start", "stop"), s)) for s in spans] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, added]
            )

    schema = docs.select("*", F.lit(None).cast(SPANS).alias(spans)).schema
    return map_in_arrow(docs, scan, schema)


def redact_secrets(
    docs: DataFrame,
    text: str = "text",
    mask: str = "[SECRET]",
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """`docs` with each secret, overlapping spans together, replaced by `mask`.

    All rows and columns stay; a text without secrets, null or empty does not change.
    Repeated rows are masked alike; an empty table stays empty.
    """
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{a})" for a in allowed) or r"(?!)")
        for batch in batches:
            texts = []
            for value in batch.column(place):
                body = value.as_py()
                spans = find_spans(body, allow) if body else []
                texts.append(mask_spans(body, spans, mask) if spans else body)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_in_arrow(docs, scan, docs.schema)
