"""Documents to frames, frames to bounded shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.config import ROW_SHARD_BYTES
from bindery.functions import frames, integrity, text
from bindery.operators.prefix import as_of, running_total, stacked
from bindery.scratch import materialize
from bindery.sizing import TASK_BYTES, task_count

# Shard starts on one page, so that its key brings no more than 1 GiB to a task, and the
# most pages after the first of bundles, of all together.
PAGE_SHARDS = 8
DIRECTORY_ENTRIES = 1 << 18


def classify(files: DataFrame) -> DataFrame:
    """Add `is_binary`."""
    return files.withColumn("is_binary", text.is_binary(F.col("content")))


def with_body(files: DataFrame, squeezed: bool = True) -> DataFrame:
    """Add `is_binary` and `body`, the canonical text; null for binary files."""
    body = F.when(~F.col("is_binary"), text.canonical_text(F.col("content"), squeezed))
    return classify(files).withColumn("body", body)


def signed_text(squeezed: bool = True) -> Column:
    """The text of `body` that digests cover: as it will read when unpacked."""
    return F.col("body") if squeezed else text.lf_lines(F.col("body"))


def render(
    files: DataFrame, squeezed: bool = True, signed: bool = False, key: bytes | None = None
) -> DataFrame:
    """Add `is_binary` and `frame`; drops `content`. No shuffle.

    A file without path or content has no frame and is left out.
    """
    whole = files.filter(F.col("path").isNotNull() & F.col("content").isNotNull())
    bodied = with_body(whole, squeezed)
    signature = integrity.signature(signed_text(squeezed), key) if signed else None
    frame = frames.render_frame(F.col("path"), F.col("body"), F.col("is_binary"), signature)
    return bodied.withColumn("frame", frame).drop("content", "body")


def pack_weight() -> Column:
    """Upper bound of the packed bytes of a file, from its catalog row."""
    return F.col("size") + F.octet_length("path") + frames.FRAME_OVERHEAD


def _placed(files: DataFrame, weight: Column | None = None) -> DataFrame:
    """`bundle, seq, _end, _end_before`: where in its bundle each file lies, in bytes."""
    slim = files.select(
        "bundle", "seq", (pack_weight() if weight is None else weight).alias("_weight")
    )
    return running_total(slim, ["bundle"], "seq", F.col("_weight"), "_end")


def _shards(placed: DataFrame, budget: int) -> DataFrame:
    return placed.select("bundle", "seq", F.expr(f"_end_before div {int(budget)}").alias("shard"))


def shard_plan(
    files: DataFrame,
    budget: int = ROW_SHARD_BYTES,
    weight: Column | None = None,
) -> DataFrame:
    """`bundle, seq, shard`: the budget step in which a file begins.

    Works on catalog columns only. A shard holds at most the budget and the
    part of its last file that runs over.
    """
    return _shards(_placed(files, weight), budget)


def task_plan(placed: DataFrame, budget: int, task_bytes: int) -> tuple[Column, DataFrame, int]:
    """The task of a `shard`, the table of `bundle, _base` it needs, and how many tasks.

    Bundles are laid end to end in name order. A shard begins at its bundle's base and
    `shard` budgets more, and goes to the task within whose stretch of bytes it begins. So
    tasks hold even bytes, up to one shard more, be bundles many and small or one and hot.
    """
    totals = placed.groupBy("bundle").agg(F.max("_end").alias("_bytes"))
    bases = stacked(totals, "bundle", "_bytes", "_base")
    held = bases.agg(F.max(F.col("_base") + F.col("_bytes"))).first()[0] or 0
    width = task_count(placed.sparkSession)
    step = max(1, min(task_bytes, -(-held // width)))
    task = F.expr(f"cast((_base + shard * {int(budget)}) div {step} as int)")
    return task, bases.select("bundle", "_base"), held // step + 1


def shard_pages(
    plan: DataFrame, span: int, task: Column | None = None, bases: DataFrame | None = None
) -> DataFrame:
    """`bundle, page, cuts`: the shards of a plan in short form, one entry for each shard
    (`start`, its least `seq`, `shard` and, where planned, `task`), `span` of them on a
    page; written."""
    starts = plan.groupBy("bundle", "shard").agg(F.min("seq").alias("start"))
    entry = ["start", "shard"]
    if task is not None:
        starts = starts.join(bases, "bundle").withColumn("task", task)
        entry.append("task")
    rank = F.row_number().over(Window.partitionBy("bundle").orderBy("start", "shard"))
    paged = starts.withColumn("page", F.floor((rank - 1) / span).cast("int"))
    cuts = F.sort_array(F.collect_list(F.struct(*entry))).alias("cuts")
    return materialize(paged.groupBy("bundle", "page").agg(cuts), "pages")


def _assign(
    rows: DataFrame,
    plan: DataFrame,
    span: int,
    entries: int,
    task: Column | None = None,
    bases: DataFrame | None = None,
) -> DataFrame:
    pages = shard_pages(plan, span, task, bases)
    held = pages.filter("page > 0").count()
    if held > entries:
        pages = shard_pages(plan, span * -(-held // entries), task, bases)
    firsts = F.sort_array(F.collect_list(F.get("cuts", F.lit(0))["start"])).alias("_firsts")
    directory = pages.groupBy("bundle").agg(firsts).filter(F.size("_firsts") > 1)
    page = F.when(F.col("_firsts").isNull(), F.lit(0)).otherwise(as_of("_firsts", "seq"))
    found = (
        rows.join(F.broadcast(directory), "bundle", "left")
        .withColumn("_page", page)
        .join(pages.toDF("bundle", "_page", "_cuts"), ["bundle", "_page"])
        .withColumn("_starts", F.col("_cuts.start"))
        .withColumn("shard", F.get("_cuts.shard", as_of("_starts", "seq")))
    )
    if task is not None:
        found = found.withColumn("task", F.get("_cuts.task", as_of("_starts", "seq")))
    return found.drop("_page", "_firsts", "_cuts", "_starts")


def assign_shards(
    rows: DataFrame,
    files: DataFrame,
    budget: int = ROW_SHARD_BYTES,
    span: int = PAGE_SHARDS,
    entries: int = DIRECTORY_ENTRIES,
) -> DataFrame:
    """Add `shard` to content rows, planned from the catalog columns of `files`
    (`bundle, seq, path, size`), which may come from a source without content.

    A row belongs to the last shard that starts at or before it, whatever the gaps
    between order values. It finds its page of `span` starts by the first starts of its
    bundle's pages, which are broadcast where there are several: `entries` pages beyond
    the first ones, or pages are made longer. So the join by page brings no more than `span` shards to one key; Spark
    broadcasts the pages too where their measured size allows, and the content then
    stays where it is.
    """
    return _assign(rows, shard_plan(files, budget), span, entries)


def assign_tasks(
    rows: DataFrame,
    files: DataFrame,
    budget: int = ROW_SHARD_BYTES,
    task_bytes: int = TASK_BYTES,
    span: int = PAGE_SHARDS,
    entries: int = DIRECTORY_ENTRIES,
) -> tuple[DataFrame, int]:
    """Add `shard`, as `assign_shards` does, and `task`, which will write it; returns the
    number of tasks too. Tasks hold `task_bytes` each, less where there would be fewer
    than the session's shuffle width. An empty catalog has one task."""
    placed = _placed(files)
    task, bases, tasks = task_plan(placed, budget, task_bytes)
    return _assign(rows, _shards(placed, budget), span, entries, task, bases), tasks


def concat_shards(rendered: DataFrame) -> DataFrame:
    """One row per shard: `bundle, shard, n_files, n_bytes, text`.

    Safe as a row because a shard's bytes are bounded; for files on storage
    `sinks.write_bundles` writes the frames without building the text.
    """
    return rendered.groupBy("bundle", "shard").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.octet_length("frame").cast("bigint")).alias("n_bytes"),
        F.expr("listagg(frame, '') within group (order by seq)").alias("text"),
    )


def pack(
    files: DataFrame,
    budget: int = ROW_SHARD_BYTES,
    squeezed: bool = True,
    signed: bool = False,
    key: bytes | None = None,
) -> DataFrame:
    """Ordered concatenation of frames per bundle, in shards of bounded size."""
    rendered = render(files, squeezed, signed, key).select("bundle", "seq", "frame")
    return concat_shards(assign_shards(rendered, files, budget))
