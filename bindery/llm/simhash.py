"""Document fingerprints by SimHash, with built-in functions alone.

Terms are pairs of neighbouring words, repeats included; a longer pair, which is
rarer, weighs more. Two 64-bit hashes of a term vote with its weight on 128 signed
bits. The votes of a document are 64 sums: bits j and j + 32 of a hash are counted in
the two halves of one long, so each sum serves two bits.

Fingerprints within a Hamming radius are found by permuted block tables. The bits are
cut into words, and each word is allowed so many differing bits that a pair within the
radius keeps to it in one word at least. Each word in turn is put in front as the key of
a join; a query asks for its word with every choice of up to the allowed bits flipped,
and the whole fingerprints of the rows that meet are compared.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import BLANKS, hex_sha256, shuffle_width
from bindery.scratch import materialize

BITS = 128
#: Near copies are 12 of the 128 bits apart on average.
RADIUS = 16
#: Words of the block tables: 21 or 22 bits each, so that keys stay selective.
WORDS = 6
#: Weight of a term: 1 and one more for each so many characters, 4 at most.
WEIGHT_CHARS = 6
_LANES = [(word, j) for word in ("a", "b") for j in range(32)]
_LEAST = -(2**63)


def _terms(text: str) -> Column:
    """Hashes of the weighted terms; the two low bits hold the weight less one."""
    pair = (
        f"xxhash64(v, w) & -4L | least(3, (char_length(v) + coalesce(char_length(w), 0)) div {WEIGHT_CHARS})"
    )
    return F.expr(f"zip_with({text}, slice({text}, 2, size({text})), (v, w) -> {pair})")


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and `high`, `low`: the fingerprint of `text` in two longs. `keys` are unique.

    A text without words has fingerprint 0.
    """
    body = F.btrim(F.col(text), F.lit(" \t\n\r\x0b\x0c"))
    words = F.when(F.length(body) > 0, F.split(body, BLANKS)).otherwise(F.array())
    terms = rows.select(*keys, words.alias("words")).select(
        *keys, F.explode_outer(_terms("words")).alias("term")
    )
    voting = terms.select(
        *keys,
        F.expr("(term & 3L) + 1L").alias("weight"),
        F.when(F.col("term").isNotNull(), F.xxhash64("term", F.lit(1))).alias("a"),
        F.when(F.col("term").isNotNull(), F.xxhash64("term", F.lit(2))).alias("b"),
    )
    lanes = [
        F.expr(f"sum((shiftright({word}, {j}) & 4294967297L) * weight)").alias(f"{word}{j}")
        for word, j in _LANES
    ]
    votes = voting.groupBy(*keys).agg(F.sum("weight").alias("total"), *lanes)

    def word(name: str) -> Column:
        bits = [
            f"if(2 * (shiftrightunsigned({name}{j}, {half}) & 4294967295L) > total, shiftleft(1L, {j + half}), 0L)"
            for half in (0, 32)
            for j in range(32)
        ]
        return F.coalesce(F.expr(" | ".join(bits)), F.lit(0).cast("long"))

    return votes.select(*keys, word("a").alias("high"), word("b").alias("low"))


def likeness(high: str, low: str, other_high: str, other_low: str) -> Column:
    """Share of equal bits of two fingerprints."""
    return F.expr(
        f"1D - (bit_count({high} ^ {other_high}) + bit_count({low} ^ {other_low})) / {BITS}D"
    )


def as_hex(high: str, low: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (high, low))))


def _words(radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bit after the last, differing bits allowed) of each word that is searched."""
    cuts = [BITS * i // WORDS for i in range(WORDS + 1)]
    least, more = divmod(radius + 1, WORDS)
    allowed = [least - (i >= more) for i in range(WORDS)]
    return [w for w in zip(cuts, cuts[1:], allowed) if w[2] >= 0]


def _word(start: int, stop: int, high: str = "high", low: str = "low") -> str:
    """SQL of the bits from `start` to `stop` of a fingerprint, as a long."""
    parts, place = [], 0
    for name, first in ((high, 0), (low, 64)):
        a, b = max(start, first) - first, min(stop, first + 64) - first
        if a < b:
            parts.append(f"shiftleft(shiftrightunsigned({name}, {a}) & {(1 << (b - a)) - 1}L, {place})")
            place += b - a
    return f"({' | '.join(parts)})"


def _meetings(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """Each pair of rows within `radius` once, equal fingerprints too, with `distance`.

    `queries` has distinct `high, low`; `prints` distinct `other_high, other_low` and
    whatever else is to stay.
    """
    words = _words(radius)
    masks = [
        (i, sum(1 << bit for bit in bits))
        for i, (start, stop, most) in enumerate(words)
        for n in range(most + 1)
        for bits in combinations(range(stop - start), n)
    ]
    masks = queries.sparkSession.createDataFrame(masks, "block int, mask long")
    whole = F.expr(f"array({', '.join(_word(a, b) for a, b, _ in words)})")
    asked = queries.select("high", "low", whole.alias("words")).crossJoin(F.broadcast(masks))
    asked = asked.select("high", "low", "block", F.expr("words[block] ^ mask").alias("key"))
    tables = ", ".join(
        f"struct({i} as block, {_word(a, b, 'other_high', 'other_low')} as key)" for i, (a, b, _) in enumerate(words)
    )
    held = prints.select("*", F.inline(F.expr(f"array({tables})")))
    # The first word near enough is the one that counts.
    earlier = " and ".join(
        f"(block <= {i} or bit_count({_word(a, b)} ^ {_word(a, b, 'other_high', 'other_low')}) > {most})"
        for i, (a, b, most) in enumerate(words)
    )
    distance = F.expr("bit_count(high ^ other_high) + bit_count(low ^ other_low)")
    return (
        asked.join(held, ["block", "key"])
        .where((distance <= radius) & F.expr(earlier))
        .withColumn("distance", distance)
        .drop("block", "key")
    )


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`high, low, other_high, other_low, distance` of different fingerprints within `radius`.

    Both tables have `high, low`. Equal fingerprints are one, so copies are not paired;
    join on the fingerprint for the rows that have it.
    """
    others = prints.select(F.col("high").alias("other_high"), F.col("low").alias("other_low")).distinct()
    found = _meetings(queries.select("high", "low").distinct(), others, radius).where("distance > 0")
    return found.select("high", "low", "other_high", "other_low", "distance")


def documents_within(queries: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`high, low, within, found` for every fingerprint of `queries`.

    `rows` has `doc_id, high, low`. `within` has a class for each fingerprint of `rows`
    within `radius`, the equal one included: its `distance`, its least `doc_id` and the
    number of its `rows`, sorted. `found` counts the rows of all classes.
    """
    classes = rows.groupBy(F.col("high").alias("other_high"), F.col("low").alias("other_low")).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")
    )
    found = _meetings(queries.select("high", "low").distinct(), classes, radius)
    return found.groupBy("high", "low").agg(
        F.sort_array(F.collect_list(F.struct("distance", "doc_id", "rows"))).alias("within"),
        F.sum("rows").alias("found"),
    )


def _bucket(bounds: list[int]) -> Column:
    """How many of the ascending `bounds` are at most `k`, by halving."""
    depth = len(bounds).bit_length()
    padded = [*bounds, *[None] * ((1 << depth) - 1 - len(bounds))]
    if not padded:
        return F.lit(0)
    table = F.array(*(F.lit(b).cast("long") for b in padded))
    jumps = F.array(*(F.lit(1 << i) for i in range(depth - 1, -1, -1)))
    return F.aggregate(
        jumps,
        F.lit(0),
        lambda low, jump: F.when(F.element_at(table, low + jump) <= F.col("k"), low + jump).otherwise(low),
    )


def with_next(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """`bucket, place, own, doc_id, text, next_text`: each text beside the next lower identifier's.

    After the smallest comes the largest. Rows are dealt by ranges of the identifier,
    and the last row of each range is lent to the next one up, where its row has `own`
    0; so `place - 1` is the next document's row within the bucket. Null identifiers are
    the lowest; rows that repeat an identifier are ordered by text.
    """
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)).alias("k"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    shares = [i / buckets for i in range(1, buckets)]
    found = base.agg(F.percentile_approx("k", shares or [0.5], max(10_000, 20 * buckets))).first()[0]
    bounds = sorted(set(found or [])) if shares else []
    base = base.withColumn("bucket", _bucket(bounds))
    ends = sorted((r.bucket, r.last) for r in base.groupBy("bucket").agg(F.max("k").alias("last")).collect())
    lent = [(last, ends[(i + 1) % len(ends)][0]) for i, (_, last) in enumerate(ends)]
    spark = docs.sparkSession
    targets = spark.createDataFrame(lent, "k long, to int")  # a row for each bucket
    guests = base.where(F.col("k").isin([k for k, _ in lent])).groupBy("k").agg(F.max("text").alias("text"))
    guests = guests.join(F.broadcast(targets), "k").select(
        F.col("to").alias("bucket"), F.lit(0).alias("own"), F.lit(None).cast("long").alias("doc_id"), "k", "text"
    )
    rows = base.select("bucket", F.lit(1).alias("own"), "doc_id", "k", "text").unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("own", "k", "text")
    return rows.select(
        "bucket",
        F.row_number().over(order).alias("place"),
        "own",
        "doc_id",
        "text",
        F.lag("text", 1, "").over(order).alias("next_text"),
    )


def edited_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """A row for each row of `docs`: its fingerprint, and that of the text half replaced.

    `doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_within, within`. The edited text has its last half replaced by as many
    first characters of the next document, by descending identifier. `n_within` counts
    the other rows within `radius` for rows whose identifier is divisible by 20, rows of
    an equal fingerprint included; `within` names them by classes, see
    `documents_within`, where the row's own class has distance 0 and counts the row
    itself. Both are null for the rest. A null text is empty; a text without words has fingerprint 0.
    Null identifiers come last in descending order; repeated rows are each other's next.
    Other columns are not read; an empty table gives no rows.
    """
    rows = with_next(docs, doc_id, text, 4 * shuffle_width(docs.sparkSession))
    half = F.expr("char_length(text) div 2")
    rows = rows.withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), (F.length("text") - half).cast("int")),
            F.substring("next_text", F.lit(1), half.cast("int")),
        ),
    ).select(
        "bucket",
        "place",
        "own",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        hex_sha256(F.col("edited")).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("kind", "body"),
    )
    keys = ["bucket", "place", "own", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(rows, [*keys, "kind"], "body")

    def of(kind: int, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(name)))

    prints = prints.groupBy(*keys).agg(
        of(0, "high").alias("high"),
        of(0, "low").alias("low"),
        of(1, "high").alias("edited_high"),
        of(1, "low").alias("edited_low"),
    )
    order = Window.partitionBy("bucket").orderBy("place")
    prints = prints.select(
        "*", F.lag("high").over(order).alias("next_high"), F.lag("low").over(order).alias("next_low")
    ).where("own = 1")
    prints = materialize(prints, "fingerprints")

    queries = prints.where("doc_id % 20 = 0")
    found = materialize(documents_within(queries, prints, radius), "within")
    asked = F.expr("doc_id % 20 = 0")
    return prints.join(found, ["high", "low"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("high", "low").alias("fingerprint"),
        as_hex("edited_high", "edited_low").alias("edited_fingerprint"),
        likeness("high", "low", "edited_high", "edited_low").alias("near_edited"),
        likeness("high", "low", "next_high", "next_low").alias("near_next"),
        F.when(asked, F.col("found") - 1).alias("n_within"),
        F.when(asked, F.col("within")).alias("within"),
    )
