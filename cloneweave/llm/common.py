"""Helpers the operators share: tables, the shared folder, staged tables, bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir; only where the session has none and runs on one
    machine (tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="cloneweave-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    made.append(path)
    return path


made: list[str] = []  # paths given out, in order


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths of the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in made:
            made.remove(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it: lineage ends and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def held_out(key: Column) -> Column:
    return F.coalesce(remainder(key) == 2, F.lit(False))


def sample_per_class(rows: DataFrame, keys: list[str], label: str, most: int, seed: int = 7, labels: int = 1000) -> DataFrame:
    """At most ``most`` rows of each label, those of smallest seeded hash of the keys; rows of equal keys and label are one.

    Labels are counted first, and only the ``labels`` most frequent are kept; a
    hash threshold then leaves about twice what is wanted of each, repeated rows
    fall together before the shuffle, and each task ranks no more than ``most``.
    """
    rank = F.xxhash64(F.lit(seed), *keys)
    unit = F.pmod(rank, F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.approx_count_distinct(rank).alias("n")).orderBy(F.desc("n"), label).limit(labels).collect()
    share = F.lit(0.0)
    for value, n in found:
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, (2.0 * most + 64) / max(1, n)))).otherwise(share)
    w = Window.partitionBy(label).orderBy(rank, *keys)
    return rows.filter(unit < share).dropDuplicates([*keys, label]).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
