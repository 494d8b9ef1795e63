"""Which files go into a bundle, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.config import PackConfig
from bindery.functions import globs
from bindery.operators.patterns import compile_index, keyless_match, matched_keys
from bindery.operators.prefix import running_total
from bindery.scratch import materialize

# Outcomes, in the order the tests are made.
UNREADABLE = "UNREADABLE"
DOT, SKIP, SIZE, NAME, TYPE, CAP, OK = "DOT", "SKIP", "SIZE", "NAME", "TYPE", "CAP", "OK"
# Of arguments and listed names without a file, in the report of a run.
MISSING = "MISSING"

# A pattern table up to this size becomes one regex; beyond it, an index of fragments.
INLINE_PATTERNS = 2000
# A bundle with more files is spread where limits are joined.
HOT_FILES = 1_000_000


def is_dot(base_name: Column) -> Column:
    return F.startswith(base_name, F.lit("."))


def matches_skip(base_name: Column, path: Column, patterns) -> Column:
    """Any pattern matches the base name or the whole path as given."""
    return globs.matches_any_glob(base_name, patterns) | globs.matches_any_glob(path, patterns)


def within_size(size: Column, max_bytes: int) -> Column:
    """False where the size is unknown; the limit itself is allowed."""
    return size.isNotNull() & (size <= F.lit(max_bytes))


def allowed_type(ext: Column, extensions: list[str]) -> Column:
    return ext.isin(*extensions) if extensions else F.lit(True)


def _rejections(
    cfg: PackConfig, skipped: Column | None = None, held: bool = False
) -> list[tuple[Column, str]]:
    """(test that rejects a file, its reason), in the order the tests are made.

    `held` says that the rows have their content, of which a null size means there is none.
    """
    base, path = F.col("base_name"), F.col("path")
    # A file without path or content has no frame; the other tests are never null after this.
    unreadable = path.isNull() | F.col("size").isNull() if held else path.isNull()
    tests: list[tuple[Column, str]] = [(unreadable, UNREADABLE)]
    if not cfg.include_hidden:
        tests.append((is_dot(base), DOT))
    if skipped is not None:
        tests.append((skipped, SKIP))
    elif cfg.skip_patterns:
        tests.append((matches_skip(base, path, cfg.skip_patterns), SKIP))
    if cfg.max_bytes is not None:
        tests.append((~within_size(F.col("size"), cfg.max_bytes), SIZE))
    if cfg.name_pattern:
        tests.append((~globs.matches_glob(base, cfg.name_pattern), NAME))
    if cfg.extensions:
        tests.append((~allowed_type(F.col("ext"), cfg.extensions), TYPE))
    return tests


def admission_reason(
    cfg: PackConfig, skipped: Column | None = None, held: bool = False
) -> Column:
    """First failing test per file, or OK.

    Expects `path`, `base_name`, `ext` and `size`. `skipped` replaces the skip
    patterns of the settings with a flag computed elsewhere. `held` rows have their
    content; a null size is then null content.
    """
    (first, label), *others = _rejections(cfg, skipped, held)
    chain = F.when(first, F.lit(label))
    for test, label in others:
        chain = chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(OK))


def with_reason(files: DataFrame, cfg: PackConfig) -> DataFrame:
    """Add `reason`; with a file cap, later admitted files get CAP."""
    reason = admission_reason(cfg, held="content" in files.columns)
    reasoned = files.withColumn("reason", reason)
    return reasoned if cfg.file_cap is None else mark_cap(reasoned, cfg.file_cap)


def admit(files: DataFrame, cfg: PackConfig) -> DataFrame:
    """Files with reason OK, by plain conditions that scans can evaluate."""
    for test, _ in _rejections(cfg, held="content" in files.columns):
        files = files.filter(~test)
    return files if cfg.file_cap is None else file_cap(files, cfg.file_cap, per_bundle=False)


def admission_counts(reasoned: DataFrame) -> DataFrame:
    return reasoned.groupBy("reason").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def skip_by_table(
    files: DataFrame, patterns: DataFrame, inline_limit: int = INLINE_PATTERNS
) -> DataFrame:
    """Drop files that match any glob of a one-column pattern table.

    A short table (its size is checked, not assumed) becomes one regex, tested
    where the files are. A longer one is looked up by its rarest text fragments
    (`patterns.matched_keys`), and its globs without any literal text, which have to be
    tried on every path, are tested where the files are. Either way a file without a
    path matches nothing and stays, and a bad glob raises `GlobError` before any file
    is read.
    """
    name = patterns.columns[0]
    distinct = patterns.select(F.col(name).alias("pattern")).na.drop().distinct()
    short = [r.pattern for r in distinct.limit(inline_limit + 1).collect()]
    if len(short) <= inline_limit:
        matched = matches_skip(F.col("base_name"), F.col("path"), short)
        return files.filter(~F.coalesce(matched, F.lit(False)))
    index = compile_index(distinct)
    rest = files.filter(~F.coalesce(keyless_match(index), F.lit(False)))
    return rest.join(matched_keys(rest, index), ["bundle", "seq"], "left_anti")


def cap_limits(files: DataFrame, n: int, groups: list[str]) -> DataFrame:
    """`*groups, files, last` of each group with more than `n` files: its files, and the
    `seq` of the last one inside the cap (null where the cap is 0).

    Reads only the order columns. Ranks come from counts of ranges, so that no
    task ever sorts a whole bundle.
    """
    ranked = running_total(files.select(*groups, "seq"), groups, "seq", F.lit(1), "rank")
    return (
        ranked.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.max(F.when(F.col("rank") <= n, F.col("seq"))).alias("last"),
        )
        .filter(F.col("files") > n)
    )


def _inside(limited: Column, last: Column) -> Column:
    """Whether a row without a limit, or one up to the last inside, is within the cap."""
    return ~limited | F.coalesce(F.coalesce("seq", F.lit(0)) <= last, F.lit(False))


def file_cap(
    files: DataFrame, n: int, per_bundle: bool = True, span: int = HOT_FILES
) -> DataFrame:
    """First `n` files by `seq`, of each bundle or of all.

    Limits of bundles with more than `span` files are broadcast: there is at most one for
    each `span` files of the input. Rows of such bundles are spread in the join with the
    other limits, so that no key brings more than `span` rows to a task.
    """
    if not per_bundle:
        return files.filter(_inside(*_limit_of_all(files, n)))
    limits = materialize(cap_limits(files, n, ["bundle"]), "limits")
    last = F.struct("last").alias("_hot")
    hot = limits.filter(F.col("files") > span).select("bundle", last)
    few = limits.filter(F.col("files") <= span).select(
        "bundle", F.lit(0).cast("long").alias("_salt"), F.struct("last").alias("_few")
    )
    salt = F.when(F.col("_hot").isNotNull(), F.xxhash64("seq")).otherwise(F.lit(0).cast("long"))
    if not hot.isEmpty():
        rows = files.join(F.broadcast(hot), "bundle", "left").withColumn("_salt", salt)
    else:
        rows = files.withColumn("_hot", F.lit(None).cast("struct<last: long>"))
        rows = rows.withColumn("_salt", F.lit(0).cast("long"))
    joined = rows.join(few, ["bundle", "_salt"], "left")
    limit = F.coalesce("_hot", "_few")
    return joined.filter(_inside(limit.isNotNull(), limit["last"])).select(*files.columns)


def _limit_of_all(files: DataFrame, n: int) -> tuple[Column, Column]:
    """Whether there are more than `n` files, and the last `seq` inside, as single values."""
    limits = materialize(cap_limits(files, n, []), "limits")
    one = limits.agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"))
    return one.select("n").scalar() > 0, one.select("last").scalar()


def mark_cap(reasoned: DataFrame, n: int) -> DataFrame:
    """Relabel admitted files after the first `n` (by `seq`, over all) as CAP."""
    inside = _inside(*_limit_of_all(reasoned.filter(F.col("reason") == OK), n))
    reason = F.when((F.col("reason") == OK) & ~inside, F.lit(CAP)).otherwise(F.col("reason"))
    return reasoned.withColumn("reason", reason)
