"""Registered queries: every operator over the whole given tables.

Long texts are returned as SHA-256, so that results stay small to compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery import stores
from bindery.config import PackConfig
from bindery.functions import frames, globs, integrity, paths, text
from bindery.operators import admission, catalog, chunks, hashtree, packing, prefix, report, unpacking
from bindery.operators import integrity as checks
from bindery.scratch import scratch_path
from bindery.sinks.bundles import write_manifest, write_planned, write_table
from bindery.sinks.files import extract_files, extract_status, split_safe
from bindery.sinks.staged import extract_commit as staged_extraction
from bindery.sources.bundles import read_bundles
from bindery.sources.frame_index import index_frames, read_frames
from bindery.sources.content import read_binary_files, read_content
from bindery.sources.tables import files_from_table
from bindery.sources.walk import catalog_paths, catalog_walk
from bindery.plans.corpus import (
    BOUNDARY_BYTES, CAP_PER_BUNDLE, CAP_TOTAL, HEADER_PATH_SQL, HMAC_KEY, NAME_PATTERNS,
    PATH_SQL, RAW_SQL, REPO_TEXT_SQL, SIZE_LIMIT, SKIP_PATTERNS, SMALL_BUDGET, TYPES,
    TYPES_TEXT_SQL, HEADER_TEXT_SQL, LETTER_ENDED_SQL, KEY_TEXT_SQL, ADMIT_MAX, ADMIT_NAME,
    EXTRACT_PATH_SQL, LABEL_GLOB_SQL, MIXED_GLOB_SQL, ODD_PATH_SQL, SPARSE_SQL, NO_CONTENT_SQL, NO_PATH_SQL,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files, with names and texts of every awkward sort."""
    return files_from_table(
        table(spark, sf_dir, "documents"),
        path=F.expr(PATH_SQL),
        content=F.expr(RAW_SQL),
        seq=F.col("doc_id"),
        bundle=F.col("source"),
    )


def sha(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.sha2(column.cast("binary"), 256).alias("sha")


ADMIT = PackConfig(
    skip_patterns=SKIP_PATTERNS, max_bytes=ADMIT_MAX, name_pattern=ADMIT_NAME, types=TYPES
)


@query
def squeeze_chunked(spark, sf_dir):
    """Texts normalised in chunks that cut characters, line ends and blank runs."""
    files = corpus(spark, sf_dir).select("bundle", "path", "content")
    keys = ["bundle", "path"]
    texts = chunks.squeeze_chunks(chunks.cut_chunks(files, 251, keys), keys)
    return chunks.join_chunks(texts, keys).select(*keys, sha("text"))


# Sources


@query
def table_files(spark, sf_dir):
    """Three more tables with text, each taken as files of its own bundle."""
    pages = files_from_table(
        table(spark, sf_dir, "pages"),
        path=F.expr("concat('pages/', page_id, '.html')"),
        content=F.col("html"), seq=F.col("page_id"), bundle=F.lit("pages"),
    )
    turns = files_from_table(
        table(spark, sf_dir, "conversations"),
        path=F.expr("concat('chat/', conv_id, '/', turn, '.', role)"),
        content=F.col("text"), seq=F.expr("conv_id * 1000 + turn"), bundle=F.lit("chat"),
    )
    items = files_from_table(
        table(spark, sf_dir, "benchmark"),
        path=F.expr("concat('items/', item_id)"),
        content=F.col("text"), seq=F.col("item_id"), bundle=F.lit("items"),
    )
    every = pages.unionByName(turns).unionByName(items)
    return every.select("bundle", "seq", "path", "base_name", "ext", "size", sha("content"))


@query
def manifest_join(spark, sf_dir):
    tracked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    return catalog.manifest_join(corpus(spark, sf_dir), tracked, "seq").select("seq", "path")


@query
def manifest_join_repeats(spark, sf_dir):
    """A list that names toxic documents twice and one document in every row."""
    labels = table(spark, sf_dir, "labels")
    tracked = labels.select(F.expr("doc_id - doc_id % 3 * toxic").alias("seq")).unionAll(
        labels.select(F.expr("if(quality = 1, 0, doc_id)").alias("seq"))
    )
    joined = catalog.manifest_join(
        corpus(spark, sf_dir).select("seq", "path"), tracked, "seq"
    )
    return joined.select("seq", "path")


@query
def manifest_unmatched(spark, sf_dir):
    """Names on the list that no admitted file has."""
    tracked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    visible = corpus(spark, sf_dir).filter(~admission.is_dot(F.col("base_name")))
    return catalog.unmatched_manifest(visible, tracked, "seq")


def _extracted_tree(spark, sf_dir) -> str:
    """The corpus as real files in the shared folder."""
    out = scratch_path(spark, "tree")
    extract_files(corpus(spark, sf_dir).select("bundle", "seq", "path", "content"), out)
    return stores.local_path(out)


@query
def extract_two_bundles(spark, sf_dir):
    """Two bundles that hold the same paths, extracted side by side and read again."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.expr("if(doc_id % 2 = 0, 'even', 'odd')").alias("bundle"),
        F.expr("concat('p', doc_id div 2)").alias("path"),
        F.col("doc_id").alias("seq"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    out = scratch_path(spark, "bundles-apart")
    extract_files(rows, out)
    out = stores.local_path(out)
    read = read_content(catalog_walk(spark, [out]))
    relative = paths.relative_path(F.col("path"), out + "/")
    return read.select(relative.alias("path"), sha("content"))


@query
def walk_files(spark, sf_dir):
    """Corpus written as files, walked with hidden entries pruned, and read."""
    out = _extracted_tree(spark, sf_dir)
    read = read_content(catalog_walk(spark, [out]))
    return read.select(
        paths.relative_path(F.col("path"), out + "/").alias("path"),
        "base_name", "ext", "size", "hidden_tree", "failed", sha("content"),
    )


@query
def walk_hidden(spark, sf_dir):
    out = _extracted_tree(spark, sf_dir)
    found = catalog_walk(spark, [out], include_hidden=True)
    return found.select(
        paths.relative_path(F.col("path"), out + "/").alias("path"), "size", "hidden_tree"
    )


@query
def named_files(spark, sf_dir):
    """Explicit paths, of which those with a dot name were never written."""
    out = scratch_path(spark, "named")
    files = corpus(spark, sf_dir)
    visible = files.filter(~admission.is_dot(F.col("base_name")))
    extract_files(visible.select("bundle", "seq", "path", "content"), out)
    named = files.select(
        F.lit(0).alias("arg"), F.concat_ws("/", F.lit(out), "bundle", "path").alias("path")
    )
    return catalog_paths(spark, named).select(
        paths.relative_path(F.col("path"), out + "/").alias("path"), "exists", "is_file", "size"
    )


@query
def binary_file_source(spark, sf_dir):
    """The corpus tree through the file source, which leaves hidden names out."""
    out = _extracted_tree(spark, sf_dir)
    read = read_binary_files(spark, out)
    inside = F.regexp_replace("path", "^.*?" + out.rsplit("/", 1)[-1] + "/", "")
    return read.select(inside.alias("path"), "base_name", "ext", "size", sha("content"))


# Admission


@query
def path_parts(spark, sf_dir):
    return corpus(spark, sf_dir).select(
        "seq", "path", "base_name", "ext", paths.parent(F.col("path")).alias("parent")
    )


@query
def dot_filter(spark, sf_dir):
    files = corpus(spark, sf_dir)
    return files.filter(~admission.is_dot(F.col("base_name"))).select("seq", "path")


@query
def hidden_tree_filter(spark, sf_dir):
    """Paths relative to the root, which is the bundle folder here."""
    files = corpus(spark, sf_dir)
    relative = F.substr("path", F.length("bundle") + 2)
    return files.filter(~paths.in_hidden_tree(relative)).select("seq", "path")


@query
def skip_filter(spark, sf_dir):
    files = corpus(spark, sf_dir)
    skipped = admission.matches_skip(F.col("base_name"), F.col("path"), SKIP_PATTERNS)
    return files.filter(~skipped).select("seq", "path")


@query
def skip_by_table(spark, sf_dir):
    patterns = spark.createDataFrame([(p,) for p in SKIP_PATTERNS], "pattern string")
    files = corpus(spark, sf_dir).select("bundle", "seq", "path", "base_name")
    return admission.skip_by_table(files, patterns).select("seq", "path")


@query
def skip_by_long_table(spark, sf_dir):
    """One glob per label, of which some match nothing, through the keyed join."""
    patterns = table(spark, sf_dir, "labels").select(F.expr(LABEL_GLOB_SQL).alias("pattern"))
    files = corpus(spark, sf_dir).select("bundle", "seq", "path", "base_name")
    return admission.skip_by_table(files, patterns, inline_limit=10).select("seq", "path")


@query
def skip_by_mixed_table(spark, sf_dir):
    """One glob per label: long shared beginnings, no literal text, or no match at all."""
    patterns = table(spark, sf_dir, "labels").select(F.expr(MIXED_GLOB_SQL).alias("pattern"))
    files = corpus(spark, sf_dir).select("bundle", "seq", "path", "base_name")
    return admission.skip_by_table(files, patterns, inline_limit=10).select("seq", "path")


@query
def size_filter(spark, sf_dir):
    files = corpus(spark, sf_dir)
    kept = admission.within_size(F.col("size"), SIZE_LIMIT)
    return files.filter(kept).select("seq", "size")


@query
def size_boundary(spark, sf_dir):
    """Limit per row equal to, or one below, the size of the row."""
    files = corpus(spark, sf_dir)
    kept = admission.within_size(F.col("size"), F.expr(BOUNDARY_BYTES))
    return files.filter(kept).select("seq", "size")


@query
def name_filter(spark, sf_dir):
    files = corpus(spark, sf_dir).select("seq", "base_name")
    return files.filter(globs.matches_any_glob(F.col("base_name"), NAME_PATTERNS))


@query
def type_filter(spark, sf_dir):
    files = corpus(spark, sf_dir)
    kept = admission.allowed_type(F.col("ext"), paths.parse_types(TYPES))
    return files.filter(kept).select("seq", "ext")


@query
def type_lists(spark, sf_dir):
    """Extension lists as data."""
    docs = table(spark, sf_dir, "documents")
    parsed = paths.type_list(F.expr(TYPES_TEXT_SQL))
    return docs.select(F.col("doc_id").alias("seq"), F.array_join(parsed, "|").alias("types"))


@query
def admission_reason(spark, sf_dir):
    return admission.with_reason(corpus(spark, sf_dir), ADMIT).select("seq", "reason")


@query
def admission_counts(spark, sf_dir):
    return admission.admission_counts(admission.with_reason(corpus(spark, sf_dir), ADMIT))


@query
def capped_reason(spark, sf_dir):
    """Admission with a cap over all files; later ones are CAP."""
    files = corpus(spark, sf_dir).select("seq", "path", "base_name", "ext", "size")
    reasoned = files.withColumn("reason", admission.admission_reason(PackConfig()))
    return admission.mark_cap(reasoned, CAP_TOTAL).select("seq", "reason")


@query
def file_cap(spark, sf_dir):
    files = corpus(spark, sf_dir).select("bundle", "seq")
    return admission.file_cap(files, CAP_PER_BUNDLE)


@query
def file_cap_sparse(spark, sf_dir):
    """The cap where order values lie far apart and in no order of the table."""
    files = corpus(spark, sf_dir).select("bundle", F.expr(SPARSE_SQL).alias("seq"))
    return admission.file_cap(files, CAP_PER_BUNDLE)


def _with_nulls(spark, sf_dir) -> DataFrame:
    """The corpus without some paths and some contents."""
    return files_from_table(
        table(spark, sf_dir, "documents"),
        path=F.expr(f"case when {NO_PATH_SQL} then null else {PATH_SQL} end"),
        content=F.expr(f"case when {NO_CONTENT_SQL} then null else {RAW_SQL} end"),
        seq=F.col("doc_id"),
        bundle=F.col("source"),
    )


@query
def admission_nulls(spark, sf_dir):
    """Reasons beside what the pack run admits, with null paths and contents."""
    files = _with_nulls(spark, sf_dir)
    reasons = admission.with_reason(files, ADMIT).select("seq", "reason")
    admitted = admission.admit(files, ADMIT).select("seq", F.lit(True).alias("admitted"))
    return reasons.join(admitted, "seq", "left").select(
        "seq", "reason", F.coalesce("admitted", F.lit(False)).alias("admitted")
    )


@query
def admission_stored_sizes(spark, sf_dir):
    """Reasons where the table stores a size for rows without content too."""
    files = files_from_table(
        table(spark, sf_dir, "documents"),
        path=F.expr(PATH_SQL),
        content=F.expr(f"case when {NO_CONTENT_SQL} then null else {RAW_SQL} end"),
        seq=F.col("doc_id"),
        bundle=F.col("source"),
        size=F.octet_length(F.expr(RAW_SQL)),
    )
    return admission.with_reason(files, ADMIT).select("seq", "reason")


@query
def pack_nulls(spark, sf_dir):
    """Files and bytes packed of a corpus with null paths and contents."""
    packed = packing.pack(_with_nulls(spark, sf_dir), budget=SMALL_BUDGET)
    return packed.groupBy("bundle").agg(
        F.sum("n_files").alias("n_files"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.octet_length("text").cast("long")).alias("text_bytes"),
    )


@query
def union_inputs(spark, sf_dir):
    """Two overlapping inputs; the overlap is there twice."""
    files = corpus(spark, sf_dir).select("seq", "path")
    return catalog.union_inputs(files.filter("seq % 3 < 2"), files.filter("seq % 3 > 0"))


@query
def input_order(spark, sf_dir):
    """Rank of each file by argument, then path."""
    files = corpus(spark, sf_dir).select(F.col("seq").alias("doc_id"), "path")
    inputs = catalog.union_inputs(files.filter("doc_id % 3 < 2"), files.filter("doc_id % 3 > 0"))
    ordered = catalog.assign_seq(inputs, "arg", "path")
    ranked = prefix.running_total(ordered, [], "seq", F.lit(1), "position")
    return ranked.select("arg", "path", "position")


# Content


@query
def binary_flag(spark, sf_dir):
    content = F.col("content")
    return corpus(spark, sf_dir).select(
        "seq",
        text.control_count(content).cast("long").alias("ctl"),
        F.least("size", F.lit(text.HEAD_BYTES)).cast("long").alias("head_len"),
        text.is_binary(content).alias("is_binary"),
    )


@query
def utf8_text(spark, sf_dir):
    """Whole texts and one letter more, whose last bytes are cut off."""
    docs = table(spark, sf_dir, "documents")
    ended = F.expr(f"cast({LETTER_ENDED_SQL} as binary)")
    content = F.substring(ended, F.lit(1), (F.octet_length(ended) - F.col("doc_id") % 3).cast("int"))
    return docs.select(
        F.col("doc_id").alias("seq"),
        text.is_utf8(content).alias("utf8"),
        sha(text.render_text(content)),
    )


@query
def ascii_mask(spark, sf_dir):
    return corpus(spark, sf_dir).select("seq", sha(text.mask_ascii(F.col("content"))))


@query
def squeeze_blank(spark, sf_dir):
    squeezed = corpus(spark, sf_dir).select(
        "seq", text.squeeze(F.col("content").cast("string")).alias("squeezed")
    )
    return squeezed.select(
        "seq", sha("squeezed"), F.octet_length("squeezed").cast("long").alias("n_bytes")
    )


@query
def blank_run_audit(spark, sf_dir):
    runs = corpus(spark, sf_dir).select(
        "seq", text.blank_runs(F.col("content").cast("string")).alias("r")
    )
    return runs.select(
        "seq",
        F.size("r").cast("long").alias("runs"),
        F.coalesce(F.array_max("r"), F.lit(0)).cast("long").alias("longest_run"),
    )


@query
def roundtrip_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("seq", sha(text.roundtrip_text(F.col("content"))))


@query
def preview(spark, sf_dir):
    cut = corpus(spark, sf_dir).select("seq", F.col("content").cast("string").alias("t"))
    t = F.col("t")
    return cut.select(
        "seq",
        text.preview_head(t).alias("head"),
        text.preview_middle(t).alias("mid"),
        text.preview_tail(t).alias("tail"),
    )


@query
def prefix_digest(spark, sf_dir):
    return corpus(spark, sf_dir).select("seq", text.prefix_digest(F.col("content")).alias("sha"))


# Frames and bundles


@query
def frame_render(spark, sf_dir):
    return packing.render(corpus(spark, sf_dir)).select("seq", sha("frame"))


@query
def signed_frames(spark, sf_dir):
    rendered = packing.render(corpus(spark, sf_dir), signed=True, key=HMAC_KEY)
    return rendered.select("seq", sha("frame"))


@query
def pack_bundles(spark, sf_dir):
    """Every bundle as ordered text, in shards of the default size."""
    packed = packing.pack(corpus(spark, sf_dir))
    return packed.select("bundle", "shard", "n_files", "n_bytes", sha("text"))


@query
def pack_shards(spark, sf_dir):
    """The same with shards so small that every bundle has several."""
    packed = packing.pack(corpus(spark, sf_dir), budget=SMALL_BUDGET)
    return packed.select("bundle", "shard", "n_files", "n_bytes", sha("text"))


@query
def shard_plan(spark, sf_dir):
    files = corpus(spark, sf_dir).select("bundle", "seq", "path", "size")
    return packing.shard_plan(files, SMALL_BUDGET)


@query
def shard_plan_sparse(spark, sf_dir):
    """The plan where order values lie far apart."""
    files = corpus(spark, sf_dir).select("bundle", "path", "size", F.expr("seq * 5000").alias("seq"))
    return packing.shard_plan(files, SMALL_BUDGET)


@query
def bundle_names(spark, sf_dir):
    """Output names per bundle, with the largest seq as the epoch."""
    per = corpus(spark, sf_dir).groupBy("bundle").agg(F.max("seq").alias("epoch"))
    name = paths.bundle_name(F.concat(F.col("bundle"), F.lit("_main")), F.col("epoch"))
    return per.select("bundle", name.alias("file_name"))


def _packed(spark, sf_dir) -> DataFrame:
    return packing.pack(corpus(spark, sf_dir))


@query
def unpack_frames(spark, sf_dir):
    unpacked = unpacking.unpack(_packed(spark, sf_dir))
    return unpacked.select("bundle", "path", "kind", sha(F.coalesce("body", F.lit(""))))


@query
def restore_text(spark, sf_dir):
    restored = unpacking.restore(unpacking.unpack(_packed(spark, sf_dir)))
    return restored.select("bundle", "path", sha("content"))


@query
def bundle_files(spark, sf_dir):
    """Bundles of small shards written by planned tasks, read back and restored."""
    files, out = corpus(spark, sf_dir), scratch_path(spark, "bundles")
    write_planned(*packing.assign_tasks(packing.render(files), files, SMALL_BUDGET), out)
    restored = unpacking.restore(read_bundles(spark, out))
    return restored.select("bundle", "path", sha("content"))


@query
def unpack_some(spark, sf_dir):
    """The frames of bad documents alone, sought out in bundle files by their index."""
    files, out = corpus(spark, sf_dir), scratch_path(spark, "bundles")
    write_planned(*packing.assign_tasks(packing.render(files), files, SMALL_BUDGET), out)
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    bad = table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1").select("doc_id").distinct()
    listed = index_frames(spark, out).withColumn("doc_id", number).join(bad, "doc_id", "left_semi")
    some = read_frames(listed)
    return some.select("bundle", "path", "kind", sha(F.coalesce("body", F.lit(""))))


@query
def frame_table(spark, sf_dir):
    """Frames written as a table and read back."""
    out = scratch_path(spark, "frames")
    rendered = packing.render(corpus(spark, sf_dir))
    write_table(rendered.select("bundle", "seq", "path", "is_binary", "frame"), out)
    return spark.read.parquet(out).select("bundle", "seq", "path", "is_binary", sha("frame"))


@query
def extract_counts(spark, sf_dir):
    return unpacking.extract_counts(unpacking.unpack(_packed(spark, sf_dir)))


@query
def last_wins(spark, sf_dir):
    """Paths folded onto fifty names, so that most are written many times."""
    folded = corpus(spark, sf_dir).select(
        "bundle", F.expr("concat('doc_', seq % 50)").alias("path"), "seq", sha("content")
    )
    return unpacking.last_wins(folded)


@query
def header_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    header = F.expr(HEADER_TEXT_SQL)
    return docs.select(
        F.col("doc_id").alias("seq"),
        frames.header_path(header).alias("path"),
        frames.header_signature(header).alias("signature"),
    )


@query
def key_blocks(spark, sf_dir):
    """A key block before every bundle, some with a key of the wrong form."""
    bundles = corpus(spark, sf_dir).groupBy("bundle").agg(F.min("seq").alias("seq"))
    bundles = bundles.withColumn("text", frames.key_block(F.expr(KEY_TEXT_SQL)))
    return unpacking.key_blocks(unpacking.unpack(bundles))


@query
def collision_audit(spark, sf_dir):
    audit = unpacking.bundle_audit(corpus(spark, sf_dir))
    return audit.select("seq", "collides", "not_utf8", "lossy")


@query
def path_audit(spark, sf_dir):
    """Paths that a header does and does not give back."""
    files = files_from_table(
        table(spark, sf_dir, "documents"),
        path=F.expr(ODD_PATH_SQL), content=F.expr(RAW_SQL), seq=F.col("doc_id"),
    )
    return unpacking.bundle_audit(files).select("seq", "path", "bad_path")


# Integrity


@query
def integrity_manifest(spark, sf_dir):
    manifest = checks.integrity_manifest(corpus(spark, sf_dir))
    return manifest.select("bundle", "path", "size", "sha256", "raw_sha256")


@query
def keyed_digest(spark, sf_dir):
    manifest = checks.integrity_manifest(corpus(spark, sf_dir), HMAC_KEY)
    return manifest.select("bundle", "path", F.col("sha256").alias("sha"))


@query
def manifest_table(spark, sf_dir):
    """The manifest written as a table and read back."""
    out = scratch_path(spark, "manifest")
    write_manifest(checks.integrity_manifest(corpus(spark, sf_dir)), out)
    return spark.read.parquet(out).select("bundle", "seq", "path", "size", "sha256")


def _doc_number() -> Column:
    return F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")


def _tampered(unpacked: DataFrame) -> DataFrame:
    """Change every eleventh text and lose every nineteenth."""
    changed = F.when(_doc_number() % 11 == 0, F.concat("body", F.lit("changed\n")))
    return unpacked.withColumn("body", changed.otherwise(F.col("body"))).filter(
        _doc_number() % 19 != 0
    )


def _verified(spark, sf_dir) -> DataFrame:
    files = corpus(spark, sf_dir)
    manifest = checks.integrity_manifest(files).filter("seq % 17 != 0")
    unpacked = _tampered(unpacking.unpack(packing.pack(files)))
    return checks.verify(checks.frame_digests(unpacked), manifest)


@query
def verify_status(spark, sf_dir):
    return _verified(spark, sf_dir)


@query
def verify_counts(spark, sf_dir):
    return checks.status_counts(_verified(spark, sf_dir))


def _signature_checked(spark, sf_dir) -> DataFrame:
    packed = packing.pack(corpus(spark, sf_dir), signed=True, key=HMAC_KEY)
    return checks.verify_signatures(_tampered(unpacking.unpack(packed)), HMAC_KEY)


@query
def signature_status(spark, sf_dir):
    """Every frame against the signature in its own header."""
    return _signature_checked(spark, sf_dir).select("bundle", "path", "status")


@query
def quarantined_frames(spark, sf_dir):
    _, bad = checks.extract_policy(_signature_checked(spark, sf_dir), "quarantine")
    return bad.select("bundle", "path", "status")


@query
def last_then_verify(spark, sf_dir):
    """The signature of the last frame of each path, where most paths repeat."""
    packed = packing.pack(corpus(spark, sf_dir), signed=True, key=HMAC_KEY)
    frames_ = unpacking.text_frames(_tampered(unpacking.unpack(packed)))
    repeated = frames_.withColumn("path", F.concat(F.lit("p"), _doc_number() % 50))
    checked = checks.verify_signatures(unpacking.last_wins(repeated), HMAC_KEY)
    return checked.select("bundle", "path", "status")


# Addresses, paths, reports


@query
def repo_name(spark, sf_dir):
    """Page addresses as they are and turned into clone addresses of all forms."""
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    return pages.select("page_id", F.expr(REPO_TEXT_SQL).alias("url")).select(
        "page_id",
        "url",
        paths.is_repo_url(url).alias("is_repo_url"),
        paths.repo_name(url).alias("repo"),
    )


def _header_paths(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq"), F.expr(HEADER_PATH_SQL).alias("path"))


@query
def safe_path(spark, sf_dir):
    return _header_paths(spark, sf_dir).select(
        "seq", "path", paths.is_safe_path(F.col("path")).alias("safe")
    )


@query
def relative_path(spark, sf_dir):
    relative = paths.relative_path(F.col("path"), "src1/")
    return _header_paths(spark, sf_dir).select("seq", relative.alias("rel"))


@query
def path_quarantine(spark, sf_dir):
    _, unsafe = split_safe(_header_paths(spark, sf_dir))
    return unsafe.select("seq", "path")


@query
def extract_odd_paths(spark, sf_dir):
    """What becomes of each path: files beside folders of their name, two spellings of a
    path, folders and paths that leave the tree."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.lit("").alias("bundle"),
        F.expr(EXTRACT_PATH_SQL).alias("path"),
        F.col("doc_id").alias("seq"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    return extract_status(rows, scratch_path(spark, "odd")).select("path", "status")


@query
def extract_commit(spark, sf_dir):
    """The same paths, staged and published as a whole, and the files read again."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.lit("").alias("bundle"),
        F.expr(EXTRACT_PATH_SQL).alias("path"),
        F.col("doc_id").alias("seq"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    out = scratch_path(spark, "staged")
    status = staged_extraction(rows, out)
    read = read_content(catalog_walk(spark, [out]))
    root = len(stores.local_path(out)) + 1
    found = read.select(F.substr("path", F.lit(root + 1)).alias("_file"), sha("content"))
    same = (F.col("path") == F.col("_file")) & (F.col("status") == "WRITTEN")
    return status.join(found, same, "left").select("path", "status", "sha")


def _plain_files(spark, sf_dir) -> DataFrame:
    """The corpus extracted to files, some of them changed or missing, and read again."""
    number = F.col("seq")
    rows = corpus(spark, sf_dir).filter(number % 19 != 0).select(
        "bundle", "seq", "path",
        F.when(number % 11 == 0, F.concat("content", F.lit("changed\n").cast("binary")))
        .otherwise(F.col("content")).alias("content"),
    )
    out = scratch_path(spark, "plain")
    staged_extraction(rows, out).count()
    read = read_content(catalog_walk(spark, [out], include_hidden=True))
    root = len(stores.local_path(out)) + 1
    path = F.substr("path", F.lit(root + 1))
    read = read.withColumn("seq", F.lit(0).cast("long"))  # paths are unique
    return read.withColumn("bundle", F.substring_index(path, "/", 1)).withColumn(
        "path", F.substr(path, F.length(F.substring_index(path, "/", 1)) + 2)
    )


@query
def verify_plain_files(spark, sf_dir):
    """Files on disk, not frames, against a manifest that lacks some of them."""
    manifest = checks.integrity_manifest(corpus(spark, sf_dir)).filter("seq % 17 != 0")
    found = checks.integrity_manifest(_plain_files(spark, sf_dir))
    return checks.verify(found, manifest)


@query
def hash_tree(spark, sf_dir):
    """Every node of the hash tree over the manifest."""
    manifest = checks.integrity_manifest(corpus(spark, sf_dir))
    return hashtree.hash_tree(manifest, digits=2).nodes


@query
def verify_root(spark, sf_dir):
    """Missing, forged and changed files, told by a root that was kept apart."""
    files = corpus(spark, sf_dir)
    path = scratch_path(spark, "tree")
    root = hashtree.write_tree(hashtree.hash_tree(checks.integrity_manifest(files, HMAC_KEY), HMAC_KEY, digits=2), path)
    number = _doc_number()
    unpacked = unpacking.unpack(packing.pack(files)).filter(number % 97 != 5)
    changed = F.when(number % 101 == 7, F.concat("body", F.lit("changed\n"))).otherwise(F.col("body"))
    digests = checks.frame_digests(unpacked.withColumn("body", changed), HMAC_KEY)
    forged = digests.filter(number % 89 == 3).withColumn("path", F.concat("path", F.lit(".forged")))
    return hashtree.verify_root(digests.unionByName(forged), hashtree.read_tree(spark, path, HMAC_KEY), root, HMAC_KEY)


@query
def digest_text(spark, sf_dir):
    """Digests in the base64 form of headers, and whether they read back."""
    encoded = integrity.signature(F.col("content"))
    return corpus(spark, sf_dir).select(
        "seq", encoded.alias("encoded"), integrity.is_digest(encoded).alias("valid")
    )


@query
def run_summary(spark, sf_dir):
    reasoned = admission.with_reason(packing.classify(corpus(spark, sf_dir)), ADMIT)
    return report.run_summary(reasoned)


@query
def run_summary_reads(spark, sf_dir):
    """Counts of a run over real files, of which those with a dot name are gone."""
    out, files = scratch_path(spark, "partly"), corpus(spark, sf_dir)
    visible = files.filter(~admission.is_dot(F.col("base_name")))
    extract_files(visible.select("bundle", "seq", "path", "content"), out)
    named = F.concat_ws("/", F.lit(stores.local_path(out)), "bundle", "path")
    listed = files.select("bundle", "seq", "base_name", "ext", "size", named.alias("path"))
    cfg = PackConfig(include_hidden=True, max_bytes=ADMIT_MAX)
    reasoned = admission.with_reason(listed, cfg)
    return report.run_summary(packing.classify(read_content(reasoned)))
