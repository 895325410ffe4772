"""Result sinks: of rows that have a sample, a folder for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F


def _writer(rows: DataFrame) -> DataFrameWriter:
    return rows.write.partitionBy("sample") if "sample" in rows.columns else rows.write


def _chosen(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, *(c for c in rows.columns if c == "sample"))


def write_airr(rows: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated with a header; one file a sample if ``single``."""
    if single:
        rows = rows.repartition("sample") if "sample" in rows.columns else rows.coalesce(1)
    _writer(rows).option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_parquet(rows: DataFrame, path: str) -> None:
    _writer(rows).parquet(path)


def write_unassigned(rows: DataFrame, path: str) -> None:
    _writer(_chosen(rows, "sequence_id", "sequence_input")).option("header", True).csv(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Reads that failed, and why."""
    _writer(_chosen(rows, "sequence_id", "error")).option("header", True).csv(path)


def usage(rows: DataFrame, column: str = "v_gene") -> DataFrame:
    """Productive reads of each gene, most first."""
    return rows.filter("productive").groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
