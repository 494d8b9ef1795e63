"""Pack documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bindery.config import PackConfig
from bindery.operators import admission
from bindery.plans.pack import planned_frames
from bindery.sinks.bundles import write_planned


def pack_stream(
    files: DataFrame, cfg: PackConfig, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write each micro-batch of a `files` stream as its own set of bundles.

    The batch number names the folder and a repeated batch replaces it, so the
    output is exact after a restart. Admission needs no state and runs on the
    stream itself.
    """
    if cfg.file_cap is not None:
        raise ValueError("a stream has no last file, so file_cap must be None")
    admitted = admission.admit(files, cfg)

    def write_batch(batch: DataFrame, number: int) -> None:
        write_planned(*planned_frames(batch, cfg), f"{out}/batch={number}", mode="overwrite")

    writer = admitted.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
