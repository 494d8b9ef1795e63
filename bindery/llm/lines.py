"""Drops lines that an earlier line equals or differs from by one edit.

Equal lines meet by a 128-bit hash. Lines one edit apart meet by deletion
neighbourhoods: two lines of one length differ in one character if and only if they
become equal by deleting it from both; two lines whose lengths differ by one are one
edit apart if and only if deleting a character of the longer gives the shorter. So
each line sends hashes of its deletions as keys, and every key needs only the
earliest line on either side: groups are folded to minima, never listed or paired.

Whole neighbourhoods of a corpus would be a key for every character, so a line sends
only those that can meet. One edit lies in one part of a line; what stands before and
after that part is equal in both. Lines first go on halves, then on eighths: a line
whose rest is no other line's is out, and the others send deletions within the parts
where another line has an equal rest. Both steps let every pair through.

Hashes of deletions come from sums of powers over the line, all positions at once.
Every drop for one edit is verified on the two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import filter_table, free_name, map_in_arrow, maybe_in, quoted
from bindery.scratch import materialize

#: Shorter lines meet only if they are equal; by default there are none.
NEAR_CHARS = 0
PARTS = 8
#: Any odd number; sums are taken modulo 2^64.
BASE = 0x9E3779B97F4A7C15

_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class LineHashes:
    """Hashes of stretches of a line and of the line without one character."""

    def __init__(self, line: str):
        points = np.frombuffer(line.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        self.n = n = len(points)
        with np.errstate(over="ignore"):
            self.powers = np.concatenate(
                [[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)]
            )
            terms = _mix(points + np.uint64(1)) * self.powers[:-1]
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        self.inverse = np.uint64(pow(BASE, -1, 1 << 64))

    def tail(self, start: int) -> np.uint64:
        """Of the characters from `start`, as if they began the line."""
        with np.errstate(over="ignore"):
            back = np.uint64(pow(int(self.inverse), start, 1 << 64))
            return (self.sums[-1] - self.sums[start]) * back

    def without(self, start: int, stop: int) -> np.ndarray:
        """Of the line without the character at each place from `start` to `stop`."""
        with np.errstate(over="ignore"):
            after = (self.sums[-1] - self.sums[start + 1 : stop + 1]) * self.inverse
            return self.sums[start:stop] + after


def _cuts(length: int) -> list[int]:
    return [length * q // PARTS for q in range(PARTS + 1)]


def part_keys(line: str) -> Iterator[tuple[int, int, int]]:
    """(length class, part, hash of all but the part) for both roles a line can have."""
    hashes = LineHashes(line)
    for length in (hashes.n, hashes.n - 1):
        cuts = _cuts(length)
        for q in range(PARTS):
            head = hashes.sums[cuts[q]]
            tail = hashes.tail(hashes.n - (length - cuts[q + 1]))
            seed = np.array([length * PARTS + q, int(head), int(tail)], np.uint64)
            with np.errstate(over="ignore"):
                key = _mix(_mix(_mix(seed[:1]) + seed[1:2]) + seed[2:])
            yield length, q, int(key.view(np.int64)[0])


def deletion_keys(line: str, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the deletions within the given (length class, part), and each key's role.

    Role 0 meets its like (one character differs), role 1 is a whole line and meets
    role 2, a longer line without one character.
    """
    hashes, keys, roles = LineHashes(line), [], []
    n = hashes.n

    def put(values: np.ndarray, salt: np.ndarray, role: int):
        with np.errstate(over="ignore"):
            keys.append(_mix(_mix(salt.astype(np.uint64)) + values))
        roles.append(np.full(len(values), role, np.int32))

    for length, q in parts:
        cuts = _cuts(length)
        start, stop = cuts[q], cuts[q + 1]
        if length == n:
            places = np.arange(start, stop)
            put(hashes.without(start, stop), (places + 2) * (1 << 32) + length, 0)
        else:
            values = np.unique(hashes.without(start, stop + 1))
            put(values, np.full(len(values), length), 2)
    if any(length == n for length, _ in parts):
        put(hashes.sums[-1:], np.array([n]), 1)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(keys).view(np.int64), np.concatenate(roles)


def _near(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """`high, low` of lines with an earlier line one edit away.

    `lines`: `high, low, first, keys` of distinct lines; `rows`: `high, low, rank,
    line` of all, not yet computed.
    """
    keyed = lines.select("high", "low", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    halves = keyed.join(shared, "key", "left_semi").select("high", "low").distinct()
    halves = materialize(halves.join(lines.select("high", "low", "first"), ["high", "low"]), "halves")

    found = maybe_in(rows, "high", filter_table(halves.select("high"), "high"), "hit").where("hit")
    texts = found.join(halves, ["high", "low"]).where("rank = first")
    texts = materialize(
        texts.select("high", "low", "first", "line").dropDuplicates(["high", "low"]), "texts"
    )

    def send_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (h, w, *key)
                for h, w, t in zip(*(batch.column(c).to_pylist() for c in ("high", "low", "line")))
                for key in part_keys(t)
            ]
            columns = [pa.array(c) for c in zip(*out)] if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
                names=["high", "low", "length", "part", "key"],
            )

    narrow = texts.select("high", "low", "line")
    eighths = narrow.mapInArrow(send_parts, "high long, low long, length int, part int, key long")
    eighths = materialize(eighths, "eighths")
    shared = eighths.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    parts = (
        eighths.join(shared, "key", "left_semi")
        .groupBy("high", "low")
        .agg(F.collect_set(F.struct("length", "part")).alias("parts"))
    )

    def send_deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("high", "low", "line", "parts")
        for batch in batches:
            for h, w, line, parts in zip(*(batch.column(c).to_pylist() for c in names)):
                keys, roles = deletion_keys(line, [(p["length"], p["part"]) for p in parts])
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, h, np.int64)),
                        pa.array(np.full(n, w, np.int64)),
                        pa.array(keys),
                        pa.array(roles),
                    ],
                    names=["high", "low", "key", "role"],
                )

    sent = texts.drop("first").join(parts, ["high", "low"])
    sent = sent.mapInArrow(send_deletions, "high long, low long, key long, role int")
    sent = materialize(sent.join(texts.drop("line"), ["high", "low"]), "deletions")

    def least(role: int):
        return F.min(F.when(F.col("role") == role, F.col("first"))).alias(f"least{role}")

    earliest = sent.groupBy("key").agg(F.count("*").alias("n"), least(0), least(1), least(2))
    earliest = earliest.where("n > 1").drop("n")
    met = sent.join(earliest, "key").select(
        "high",
        "low",
        "first",
        F.expr("case role when 0 then least0 when 1 then least2 else least1 end").alias("other"),
    )
    met = met.where("other < first").groupBy("high", "low").agg(F.min("other").alias("other"))

    pairs = met.join(texts.select("high", "low", "line"), ["high", "low"])
    others = texts.select(F.col("first").alias("other"), F.col("line").alias("earlier"))
    pairs = pairs.join(others, "other").where(F.levenshtein("line", "earlier", 1).between(0, 1))
    return pairs.select("high", "low")


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_edits: int = 1,
    near_chars: int = NEAR_CHARS,
    counts: tuple[str, str, str] | None = None,
) -> DataFrame:
    """`docs` with `text` without the lines that an earlier line covers.

    Lines end at line feeds and are compared without outer blanks; blank ones stay. A
    line goes if an earlier line, kept or not, is equal or, where `max_edits` is 1, differs
    by one inserted, deleted or replaced character; `near_chars` asks that both lines have
    so many characters for that. Earlier means a smaller identifier, then a smaller
    number of the line; a null identifier comes last, and among those the hash of the
    text settles ties. Texts that repeat an identifier do not cover each other's line of
    one number. Rows that repeat an identifier and its
    text are treated alike and cover only what comes after them. Null and empty texts
    stay as they are, and an empty table stays empty. One text, however long, has to fit a
    task several times over; its lines go separate ways. `counts` names columns to add: lines that are not blank, those
    dropped as equal, and those dropped for one edit. All rows and columns stay.
    `max_edits` other than 0 and 1 raises `ValueError`.
    """
    if max_edits not in (0, 1):
        raise ValueError(f"max_edits is 0 or 1, not {max_edits}")
    taken = list(docs.columns)
    key, print_ = free_name("_key", taken), free_name("_print", taken)
    rows = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)))
    rows = rows.withColumn(print_, F.xxhash64(F.col(text)))

    line = F.btrim(F.col("line"), F.lit(" \t\r\x0b\x0c"))
    length = F.length("line")
    occurrences = (
        rows.select(
            F.col(key).alias("id"),
            F.col(print_).alias("print"),
            F.when(F.col(doc_id).isNull(), F.col(print_)).otherwise(0).alias("tie"),
            F.posexplode(F.split(F.col(text), "\n", -1)).alias("number", "line"),
        )
        .withColumn("line", line)
        .where(length > 0)
        .withColumn("high", F.xxhash64("line"))
        .withColumn("low", F.xxhash64(F.lit(5), F.reverse("line"), F.lit(7)))
        .withColumn("rank", F.struct("id", "number", "tie"))
    )

    def halves(m: str) -> list:
        head = F.expr(f"xxhash64('h', {m}, substring(line, 1, cast({m} div 2 as int)))")
        tail = F.expr(f"xxhash64('t', {m}, right(line, cast({m} - {m} div 2 as int)))")
        return [head, tail]

    keys = F.array(*halves("length(line)"), *halves("(length(line) - 1)"))
    slim = materialize(
        occurrences.select(
            "id",
            "print",
            "number",
            "rank",
            "high",
            "low",
            (length >= near_chars).alias("long"),
            *(keys.getItem(i).alias(f"k{i}") for i in range(4)),
        ),
        "occurrences",
    )
    distinct = slim.groupBy("high", "low").agg(
        F.min("rank").alias("first"),
        F.max("long").alias("long"),
        *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)),
    )
    distinct = materialize(distinct, "lines")
    slim = slim.select("id", "print", "number", "rank", "high", "low")
    if max_edits:
        near = _near(
            distinct.where("long").select(
                "high", "low", "first", F.array("k0", "k1", "k2", "k3").alias("keys")
            ),
            occurrences.where(length >= near_chars).select("high", "low", "rank", "line"),
        )
        near = near.select("high", "low", F.lit(True).alias("near"))
        distinct = distinct.select("high", "low", "first").join(near, ["high", "low"], "left")
        distinct = materialize(distinct, "judged")
    else:
        distinct = distinct.select("high", "low", "first", F.lit(None).cast("boolean").alias("near"))
    judged = slim.join(distinct, ["high", "low"]).where("rank != first or near")
    dropped = judged.groupBy("id", "print").agg(
        F.collect_set("number").alias("numbers"),
        F.collect_set(F.when(F.col("rank") == F.col("first"), F.col("number"))).alias("near"),
    )

    numbers, near_ = free_name("_numbers", taken), free_name("_near", taken)
    dropped = dropped.select(
        F.col("id").alias(key), F.col("print").alias(print_),
        F.col("numbers").alias(numbers), F.col("near").alias(near_),
    )
    joined = rows.join(dropped, [key, print_], "left").select(*quoted(docs.columns), numbers, near_)
    place, names = docs.columns.index(text), list(counts or ())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tallies = [], []
            gone, close = batch.column(len(taken)), batch.column(len(taken) + 1)
            for body, out, near in zip(batch.column(place), gone, close):
                body, out, near = body.as_py(), set(out.as_py() or ()), len(near.as_py() or ())
                if body is None:
                    texts.append(None)
                    tallies.append((0, 0, 0))
                    continue
                parts = body.split("\n")
                if out:
                    body = "\n".join(p for i, p in enumerate(parts) if i not in out)
                texts.append(body)
                filled = sum(1 for p in parts if p.strip(" \t\r\x0b\x0c"))
                tallies.append((filled, len(out) - near, near))
            columns = list(batch.columns)[: len(taken)]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if names:
                tallies = tallies or [(0, 0, 0)][:0]
                columns += [pa.array([t[i] for t in tallies], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*taken, *names])

    added = docs.select("*", *(F.lit(0).cast("long").alias(name) for name in names)).schema
    return map_in_arrow(joined, cut, added)
