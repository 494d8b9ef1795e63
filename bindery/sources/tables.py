"""Any table with a text or bytes column as `files`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.operators.catalog import with_path_parts


def files_from_table(
    table: DataFrame,
    path: Column,
    content: Column,
    seq: Column,
    bundle: Column | None = None,
    size: Column | None = None,
    complete: bool = False,
) -> DataFrame:
    """`seq, bundle, path, base_name, ext, size, content` from table columns.

    Give `size` where the table stores it. A row without content has no size, whatever
    is stored; `complete` promises that there is no such row, and plans that need only
    sizes then leave the content column unread.
    """
    body = content.cast("binary")
    if size is None:
        size = F.octet_length(body)
    elif not complete:
        size = F.when(body.isNotNull(), size)
    files = table.select(
        seq.cast("long").alias("seq"),
        F.coalesce(F.lit("") if bundle is None else bundle, F.lit("")).alias("bundle"),
        path.alias("path"),
        size.cast("long").alias("size"),
        body.alias("content"),
    )
    return with_path_parts(files).select(
        "seq", "bundle", "path", "base_name", "ext", "size", "content"
    )
