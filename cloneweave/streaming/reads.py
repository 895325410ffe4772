"""Annotation of a stream of reads: each micro-batch is assigned and annotated as a batch is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cloneweave.api import annotate_reads
from cloneweave.operators.annotate import AnnotateParams


def annotate_stream(reads: DataFrame, germline: DataFrame, path: str, checkpoint: str, params: AnnotateParams | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that writes annotated rows as Parquet, a folder for each batch, so that a repeated batch replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        rows, _ = annotate_reads(batch, germline, params)  # nothing is persisted, so nothing is left behind
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
