"""Pattern tables of any length over paths: an index of the rarest literal fragments.

A path that a glob matches contains every fragment of the glob's literal texts, so each
glob need be tried only on the paths that hold the rarest of them. What is counted and
exploded are hashes of fragments; a path crosses no exchange but the one that brings it
to the globs to be tried on it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import globs
from bindery.scratch import materialize

# The glob compiler goes to the tasks that use it with their code, so that it
# works where the package itself is not installed on the executors.
cloudpickle.register_pickle_by_value(globs)

# Bits of a filter for each key it holds, and its greatest size. A fuller filter lets
# more fragments through to the join, which is exact.
BITS_PER_KEY = 16
MAX_FILTER_BITS = 1 << 24
# A fragment that more paths hold is spread over tasks of this many.
HOT_PATHS = 1_000_000
# A glob whose rarest fragment more paths hold is looked up again by its short literal texts.
COMMON_PATHS = 50
# Globs without literal text in one regex.
ALTERNATIVES = 500


def compile_index(patterns: DataFrame) -> DataFrame:
    """`body, fragments, narrow` of a table of distinct globs (column `pattern`).

    Raises `GlobError` for the first bad one.
    """

    kinds = "struct<body: string, fragments: array<string>, narrow: array<string>, fault: string>"

    @F.pandas_udf(kinds)
    def compile_globs(pattern: pd.Series) -> pd.DataFrame:
        rows = []
        for one in pattern:
            try:
                found = globs.literal_fragments(one), globs.narrow_fragments(one)
                rows.append((globs.glob_body(one), *found, None))
            except globs.GlobError as fault:
                rows.append((None, None, None, str(fault)))
        return pd.DataFrame(rows, columns=["body", "fragments", "narrow", "fault"])

    compiled = materialize(
        patterns.select(compile_globs("pattern").alias("c")).select("c.*"), "globs"
    )
    bad = compiled.filter(F.col("fault").isNotNull()).first()
    if bad:
        raise globs.GlobError(bad.fault)
    return compiled.select("body", "fragments", "narrow")


def keyless_match(index: DataFrame) -> Column:
    """Any glob without literal text matches the base name or the path: alternations
    that are tested where the files are, since no key can narrow them down."""
    bodies = index.filter(F.size("fragments") == 0).select("body").distinct()
    found = sorted(row.body for row in bodies.toLocalIterator())
    chunks = [found[i : i + ALTERNATIVES] for i in range(0, len(found), ALTERNATIVES)]
    tests = [
        F.col(name).rlike(rf"(?s)\A(?:{'|'.join(chunk)})\z")
        for chunk in chunks
        for name in ("base_name", "path")
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _filter_words(keys: DataFrame, bits: int) -> Column:
    """One value for the whole plan: a set of hashed keys as an array of 64-bit words."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")
    )
    held = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word")
    dense = words.join(held, "word", "left").select(
        F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w")
    )
    return dense.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"])).scalar()


def _held(words: Column, key: Column, bits: int) -> Column:
    """Whether the filter has the key, or another of the same place."""
    place = key.bitwiseAND(F.lit(bits - 1))
    word = F.get(words, F.shiftright(place, 6).cast("int"))
    return F.bit_get(word, place.bitwiseAND(F.lit(63)).cast("int")) == F.lit(1)


def _filter_bits(keys: int) -> int:
    """A power of two that grows with the keys, up to `MAX_FILTER_BITS`."""
    return min(MAX_FILTER_BITS, max(1 << 10, 1 << (keys * BITS_PER_KEY - 1).bit_length()))


def _path_keys(widths: list[int]) -> Column:
    """Hashes of all runs of these many characters of `path`, each once."""
    path = F.col("path")

    def runs(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(path) - width + 1, F.lit(1)))
        return F.transform(starts, lambda start: F.xxhash64(F.substr(path, start, F.lit(width))))

    return F.array_distinct(F.concat(*(runs(width) for width in widths)))


def _probed(files: DataFrame, widths: list[int], keys: DataFrame, bits: int) -> DataFrame:
    """`bundle, seq, key`: the fragments of each path that the filter lets through."""
    hashed = files.select(
        "bundle", "seq", _path_keys(widths).alias("all"), _filter_words(keys, bits).alias("words")
    )
    let = F.filter("all", lambda key: _held(F.col("words"), key, bits))
    return hashed.select("bundle", "seq", F.explode(let).alias("key"))


def rarest_keys(files: DataFrame, index: DataFrame) -> DataFrame:
    """`body, key, width, paths`: for each glob, its fragment that the fewest paths hold.

    Counts only fragments of globs, which are reduced before they are shuffled. Globs of
    which no path holds some fragment match nothing and are left out.
    """
    keyed = index.filter(F.size("fragments") > 0).select(
        "body", F.explode("fragments").alias("fragment")
    )
    keyed = materialize(
        keyed.select("body", F.length("fragment").alias("width"), F.xxhash64("fragment").alias("key")),
        "fragments",
    )
    keys = keyed.select("key").distinct()
    widths = sorted(row.width for row in keyed.select("width").distinct().collect())
    if not widths:
        return keyed.withColumn("paths", F.lit(0).cast("long"))
    probed = _probed(files, widths, keys, _filter_bits(keys.count()))
    counted = probed.groupBy("key").agg(F.count(F.lit(1)).alias("paths"))
    rarest = F.min(F.struct(F.coalesce("paths", F.lit(0)).alias("paths"), "key", "width")).alias("r")
    chosen = keyed.join(counted, "key", "left").groupBy("body").agg(rarest)
    return materialize(chosen.filter("r.paths > 0").select("body", "r.*"), "rarest")


def rarer_keys(files: DataFrame, index: DataFrame, common: int = COMMON_PATHS) -> DataFrame:
    """`rarest_keys`, of the short literal texts too for globs whose key over `common` paths hold.

    `*/logs/*77.txt` has only fragments of `/logs/` in the width of its longest text; if
    many globs begin like that, each would be tried on every path of the folder.
    """
    chosen = rarest_keys(files, index)
    often = chosen.filter(F.col("paths") > common).select("body")
    narrow = index.filter(F.size("narrow") > 0).join(often, "body", "left_semi")
    narrow = materialize(narrow.select("body", F.col("narrow").alias("fragments")), "narrow")
    if narrow.isEmpty():
        return chosen
    key = F.struct("paths", "key", "width").alias("r")
    # A glob that is not found again has a short text that no path holds.
    again = rarest_keys(files, narrow).select("body", key)
    both = chosen.join(again, "body").select("body", F.least(key, "r").alias("r")).select("body", "r.*")
    rest = chosen.join(narrow.select("body").distinct(), "body", "left_anti")
    return materialize(rest.unionByName(both), "rarer")


def matched_keys(files: DataFrame, index: DataFrame, hot_paths: int = HOT_PATHS) -> DataFrame:
    """`bundle, seq` of files that a glob with literal text matches, by base name or path.

    Fragments that more than `hot_paths` paths hold are spread over salts, as many as the
    commonest needs; both sides ask one filter which keys those are, so that what else
    falls into its places is spread on both.
    """
    files = files.select("bundle", "seq", "path", "base_name").filter(F.col("path").isNotNull())
    chosen = rarer_keys(files, index)
    known = chosen.agg(
        F.count_distinct("key").alias("n"), F.max("paths").alias("most"),
        F.sort_array(F.collect_set("width")).alias("widths"),
    ).first()
    if not known.n:
        return files.select("bundle", "seq").limit(0)
    probed = _probed(files, known.widths, chosen.select("key").distinct(), _filter_bits(known.n))
    salts = -(-known.most // hot_paths)
    on = ["key"]
    if salts > 1:
        hot = chosen.filter(F.col("paths") > hot_paths).select("key").distinct()
        bits = _filter_bits(hot.count())
        words, spread = _filter_words(hot, bits), _held(F.col("words"), F.col("key"), bits)
        row_salt = F.when(spread, F.pmod(F.xxhash64("seq", "bundle"), F.lit(salts))).otherwise(F.lit(0))
        probed = probed.withColumn("words", words).withColumn("salt", row_salt.cast("int")).drop("words")
        copies = F.sequence(F.lit(0), F.when(spread, F.lit(salts - 1)).otherwise(F.lit(0)))
        chosen = chosen.withColumn("words", words).withColumn("salt", F.explode(copies)).drop("words")
        on = ["key", "salt"]
    tries = probed.join(chosen.select("body", *on), on).select("bundle", "seq", "body")
    regex = r"concat('(?s)\\A(?:', body, ')\\z')"
    matches = F.expr(f"base_name rlike {regex} or path rlike {regex}")
    return files.join(tries, ["bundle", "seq"]).filter(matches).select("bundle", "seq").distinct()
