"""Token files: every document's ids compressed alone with one shared dictionary.

Layout of a folder:

* `dictionary` - one row: `hash` (hex SHA-256), `dictionary` (a zstandard dictionary
  trained on serialized id arrays of a bounded sample; empty if there is too little
  to train on), `width` (bytes of an id, little-endian).
* `blocks` - uncompressed Parquet, one row for each block of documents in ascending
  order: `part`, `block`, `hash`, `index` (an array of doc_id, offset, size,
  n_tokens) and `payload` (the documents' frames, end to end). An id is found
  from `index` alone; its frame is `payload[offset : offset + size]`.

Spark's writer commits whole tasks, so a lost executor leaves no half file, and any
file system that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import shuffle_width, steps
from bindery.llm.tokens import STEP_BYTES, encoder

#: About so many documents, and so many characters of each, train the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2_000, 20_000, 64 * 1024
#: A block is closed at so many bytes or documents.
BLOCK_BYTES, BLOCK_DOCS = 4 * 1024 * 1024, 4_096

BLOCKS = (
    "part int, block int, hash string, "
    "index array<struct<doc_id: bigint, offset: bigint, size: bigint, n_tokens: bigint>>, payload binary"
)
#: `before`: ids of the block's earlier documents.
DOCUMENTS = "part int, block int, before long, doc_id long, n_tokens long, ids binary"


def _train(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    every = max(1, math.ceil(docs.count() / SAMPLE_DOCS))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    texts = picked.select(F.substring("text", 1, SAMPLE_CHARS)).limit(2 * SAMPLE_DOCS).collect()
    ids, ends = encoder(tokenizer).encode(pa.array([r[0] or "" for r in texts], pa.string()))
    kind = f"<u{width}"
    samples = [ids[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:]) if b > a]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the ids of every document, each ended by `end_id`, in ascending order.

    Order: null identifiers first, repeated ones by text. A null or empty text gives
    `end_id` alone; repeated rows are all written; an empty table gives no block. Only
    the two columns are read. Documents are sorted by one range shuffle of the texts.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")
    )
    size = encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)
    width = 2 if max(size, end_id) < 1 << 16 else 4
    dictionary = _train(docs, tokenizer, width)
    name = hashlib.sha256(dictionary).hexdigest()
    kind, fields = f"<u{width}", ("doc_id", "offset", "size", "n_tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, block = context.partitionId() if context else 0, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=3, dict_data=known).compress
        encode = encoder(tokenizer).encode
        frames, index, held = [], [], 0

        def close():
            nonlocal frames, index, held, block
            columns = [pa.array(c, pa.int64()) for c in zip(*index)]
            entries = pa.StructArray.from_arrays(columns, names=fields)
            row = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([name]),
                pa.ListArray.from_arrays(pa.array([0, len(index)], pa.int32()), entries),
                pa.array([b"".join(frames)], pa.binary()),
            ]
            frames, index, held, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays(
                row, names=["part", "block", "hash", "index", "payload"]
            )

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in steps(texts, STEP_BYTES):
                ids, ends = encode(texts.slice(a, b - a))
                for i in range(b - a):
                    own = np.append(ids[ends[i] : ends[i + 1]], end_id).astype(kind)
                    frame = compress(own.tobytes())
                    index.append((names[a + i], held, len(frame), len(own)))
                    frames.append(frame)
                    held += len(frame)
                    if held >= BLOCK_BYTES or len(index) >= BLOCK_DOCS:
                        yield close()
        if index:
            yield close()

    ordered = docs.repartitionByRange(shuffle_width(spark), "doc_id")
    blocks = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(write, BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame(
        [(name, bytearray(dictionary), width)], "hash string, dictionary binary, width int"
    ).coalesce(1).write.parquet(f"{path}/dictionary")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """Rows of `DOCUMENTS`: every document of the files, `ids` as unsigned 32-bit.

    Raises if a block was not written with the folder's dictionary. `blocks` limits the
    reading to those blocks and, if it has `wanted`, to those identifiers; see `read_some`.
    """
    (name, dictionary, width) = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, kind = bytes(dictionary), f"<u{width}"
    if hashlib.sha256(dictionary).hexdigest() != name:
        raise ValueError(f"the dictionary of {path} is damaged")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        expand = zstandard.ZstdDecompressor(dict_data=known).decompress
        for batch in batches:
            for part, block, found, index, payload, *wanted in zip(*(c for c in batch.columns)):
                if found.as_py() != name:
                    raise ValueError(f"block {block} of part {part} has another dictionary")
                entries, held = index.values, memoryview(payload.as_buffer())
                ends = np.cumsum(np.asarray(entries.field("n_tokens")))
                before = pa.array(np.concatenate([[0], ends[:-1]]).astype(np.int64))
                if wanted:  # only their frames are cut out and expanded
                    places = pc.indices_nonzero(pc.is_in(entries.field("doc_id"), wanted[0].values))
                    entries, before = entries.take(places), before.take(places)
                offsets = entries.field("offset").to_pylist()
                sizes = entries.field("size").to_pylist()
                ids = [
                    np.frombuffer(expand(held[o : o + n]), dtype=kind).astype("<u4").tobytes()
                    for o, n in zip(offsets, sizes)
                ]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part.as_py(), np.int32)),
                        pa.array(np.full(n, block.as_py(), np.int32)),
                        before,
                        entries.field("doc_id"),
                        entries.field("n_tokens"),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "block", "before", "doc_id", "n_tokens", "ids"],
                )

    return (_blocks(spark, path) if blocks is None else blocks).mapInArrow(read, DOCUMENTS)


def read_some(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Documents whose id is in `wanted.doc_id`; no other document's frame is expanded."""
    keys = wanted.select("doc_id").distinct()
    blocks = _blocks(spark, path)
    held = blocks.select("part", "block", F.explode("index.doc_id").alias("doc_id"))
    hit = held.join(keys, "doc_id", "left_semi").groupBy("part", "block")
    hit = hit.agg(F.collect_set("doc_id").alias("wanted"))
    return read_token_files(spark, path, blocks.join(hit, ["part", "block"]).select(*blocks.columns, "wanted"))


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """`rows` of `read_token_files` with `start`: ids of all documents before.

    Totals come from the index: of blocks within their file, and of files, whose number
    is that of the writing tasks.
    """
    totals = _blocks(spark, path).select(
        "part", "block", F.expr("aggregate(index.n_tokens, 0L, (a, n) -> a + n)").alias("total")
    )
    files = totals.groupBy("part").agg(F.sum("total").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_file"))
    earlier = (
        Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.withColumn("_block", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    starts = starts.join(files, "part").select(
        "part", "block", (F.col("_file") + F.col("_block")).alias("_start")
    )
    return (
        rows.join(starts, ["part", "block"])
        .withColumn("start", F.col("_start") + F.col("before"))
        .drop("_start")
    )
