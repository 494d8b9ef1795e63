"""Quality rules by a hashed n-gram likelihood ratio, with built-in functions alone.

Two multinomials over hashed n-grams, of trusted documents and of the raw corpus, tell by
their log ratio how much likelier each n-gram is in trusted text. A document's score is
the mean over its own n-grams, so that length does not count; every document is kept or
not by one fixed threshold on it.

Tokens are runs of letters and digits, and runs of other signs. An n-gram is a token's
bucket, or the hash of two neighbouring tokens' buckets in a second set of buckets. Log
ratios are whole numbers (1/65,536 nats): their sums do not depend on any order, and the
threshold is a comparison of integers.

One scan reads the texts and writes counts and token buckets; both multinomials and the
scores come from those. The ratios, one for each bucket, are the only data that every task
gets; their number is fixed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import BLANKS, FILTER_BITS, filter_table, maybe_in
from bindery.scratch import materialize

#: Buckets of single tokens, and as many of pairs.
BUCKETS = 1 << 14
#: Added to each bucket's count, so that no probability is zero.
SMOOTHING = 1
#: Parts of a nat in which log ratios are counted.
UNIT = 1 << 16
#: Documents below this many nats an n-gram are not kept.
THRESHOLD = -0.35
#: Bits of the largest table of trusted identifiers: two million rows of 16 bytes.
MOST_BITS = 1 << 27
#: Words of the windows whose repeats count.
WINDOW = 8

TOKENS = r"[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"


def _neighbours(array: str, step: int, combine: str) -> str:
    """SQL: `combine` of each entry `a` and the one `step` later, `b`; null at the end."""
    return f"zip_with({array}, slice({array}, {step + 1}, greatest(size({array}), 1)), (a, b) -> {combine})"


def _let(value: str, name: str, body: str) -> str:
    """SQL: `body` with `name` standing for `value`, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(windows: str) -> Column:
    """Words inside windows that occur twice or more, from an array of window hashes.

    Sorted with their places, equal hashes are neighbours. Each repeated window adds the
    words up to the next repeated one, at most its own.
    """
    same = "coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)"
    pairs = f"array_sort(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))"
    places = _let(pairs, "s", f"array_sort(transform(filter(s, (x, k) -> {same}), x -> x.i))")
    gaps = _neighbours("p", 1, f"least({WINDOW}, coalesce(b - a, {WINDOW}))")
    covered = _let(places, "p", f"aggregate({gaps}, 0L, (t, g) -> t + g)")
    return F.expr(f"CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE {covered} END")


def text_features(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, the base counts and `tokens`, the bucket of each token, a row for each row.

    `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words` (long); a null text
    has none of anything.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(" \t\n\r\x0b\x0c"))
    rows = docs.select(
        *keys,
        body.alias("body"),
        F.when(F.length(trimmed) > 0, F.split(trimmed, BLANKS)).otherwise(F.array()).alias("words"),
    )
    rows = rows.select(
        *keys,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.expr("transform(words, w -> xxhash64(w))").alias("one"),
        F.expr(f"regexp_extract_all(body, '{TOKENS}', 0)").alias("found"),
    )
    kept = [*keys, "n_words", "word_chars", "n_symbols"]
    rows = rows.select(
        *kept,
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"transform(found, t -> cast(pmod(xxhash64(t), {BUCKETS}L) as int))").alias("tokens"),
        F.expr(_neighbours("one", 1, "xxhash64(a, b)")).alias("two"),
    )
    rows = rows.select(*kept, "n_dup_lines", "tokens", F.expr(_neighbours("two", 2, "xxhash64(a, b)")).alias("four"))
    windows = f"slice({_neighbours('four', 4, 'xxhash64(a, b)')}, 1, greatest(size(four) - {WINDOW - 1}, 0))"
    rows = rows.select(*kept, "n_dup_lines", "tokens", F.expr(windows).alias("windows"))
    return rows.select(*kept, "n_dup_lines", repeated_words("windows").alias("n_repeat_words"), "tokens")


def _pairs(tokens: str) -> str:
    """SQL: the buckets of pairs, after those of tokens; null for the last token."""
    pair = f"if(b is null, null, {BUCKETS} + cast(pmod(xxhash64(a, b), {BUCKETS}L) as int))"
    return _neighbours(tokens, 1, pair)


def gram_counts(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """`bucket, n` over all rows: counted within tasks first, two rows a bucket and task."""
    ones = rows.select(F.explode(tokens).alias("bucket"))
    twos = rows.select(F.expr(_pairs(tokens)).alias("pairs")).select(F.explode("pairs").alias("bucket"))
    return ones.unionByName(twos.where("bucket is not null")).groupBy("bucket").agg(F.count("*").alias("n"))


def trusted_rows(features: DataFrame, trusted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of `features` whose identifier is in `trusted.doc_id`.

    A bit table that every task gets lets most others go before the join shuffles. It
    grows with the trusted documents, up to `MOST_BITS`, past which more rows are
    shuffled. The join is a merge at every size, so that its cost grows evenly.
    """
    keys = trusted.where("doc_id is not null").select("doc_id").distinct()
    bits, wanted = FILTER_BITS, min(MOST_BITS, 16 * keys.count())
    while bits < wanted:
        bits *= 2
    table = filter_table(keys.select(F.xxhash64("doc_id").alias("key")), "key", bits)
    rows = features.where(F.col(doc_id).isNotNull()).withColumn("_hash", F.xxhash64(doc_id))
    rows = maybe_in(rows, "_hash", table, "_maybe", bits).where("_maybe").drop("_hash", "_maybe")
    return rows.join(keys.withColumnRenamed("doc_id", doc_id).hint("merge"), doc_id, "left_semi")


def log_ratios(target: DataFrame, raw: DataFrame) -> list[int]:
    """Log of the trusted over the raw probability of each bucket, in `UNIT`s.

    From two tables of `gram_counts`, of a fixed number of rows. All are 0 where no
    document is trusted.
    """

    def shares(counts: DataFrame) -> list[float] | None:
        found = dict(counts.select("bucket", "n").collect())
        logs = []
        for start in (0, BUCKETS):
            held = [found.get(start + b, 0) + SMOOTHING for b in range(BUCKETS)]
            total = math.log(sum(held))
            logs += [math.log(n) - total for n in held]
        return logs if found else None

    wanted, all_ = shares(target), shares(raw)
    if wanted is None or all_ is None:
        return [0] * (2 * BUCKETS)
    return [round(UNIT * (a - b)) for a, b in zip(wanted, all_)]


def with_score(features: DataFrame, ratios: list[int], tokens: str = "tokens") -> DataFrame:
    """`features` with `n_grams` and `ratio_sum`, the log ratios of its n-grams in `UNIT`s."""
    table = f"cast(split('{','.join(map(str, ratios))}', ',') as array<bigint>)"

    def total(array: str) -> str:
        return f"aggregate({array}, 0L, (t, b) -> t + coalesce(get({table}, b), 0L))"

    return features.withColumn("n_grams", F.expr(f"cast(greatest(2 * size({tokens}) - 1, 0) as long)")).withColumn(
        "ratio_sum", F.expr(f"{total(tokens)} + {total(_pairs(tokens))}")
    )


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """A row for each row of `docs`: base counts, score and verdict.

    `doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_grams, score, kept`. `base_failed`: under 20 words, or over 30% of words in repeated
    windows of eight. `score` is the mean log ratio of the n-grams in nats, null without
    any; `kept` if the base did not fail and the score is not below `threshold`.
    `trusted` names the trusted documents in `doc_id`; without any, scores are 0.

    A null text counts as empty, and both fail. Null identifiers are never trusted;
    rows that repeat an identifier are judged by their own texts, and all of them are
    trusted if it is. Other columns are not read; an empty table gives no rows. Long
    texts are whole; one has to fit a task some ten times over.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    features = materialize(text_features(rows, ["doc_id"]), "features")
    ratios = log_ratios(gram_counts(trusted_rows(features, trusted)), gram_counts(features))
    least = round(threshold * UNIT)
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return (
        with_score(features, ratios)
        .withColumn("base_failed", failed)
        .withColumn("score", F.expr(f"if(n_grams = 0, null, ratio_sum / n_grams / {UNIT})"))
        .withColumn("kept", F.expr(f"not base_failed and ratio_sum >= {least} * n_grams"))
        .drop("tokens", "ratio_sum")
    )
