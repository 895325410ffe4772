"""Merging of read pairs: adapters, quality tails, overlap, consensus."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloneweave.functions.sequence import revcomp_text
from cloneweave.schema import READS
from cloneweave.sources.fastx import inputs, natural, read_fastx

# TruSeq adapters of read 1 and 2.
TRUSEQ = ("AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT")


@dataclass(frozen=True)
class MergeParams:
    overlap: int = 30
    differences: int = 5
    percent: float = 20.0
    adapters: tuple[str, str] | None = TRUSEQ
    window: int = 4
    quality: int = 20
    seed: int = 8  # bases of an adapter that must match


def stem(path: str) -> str:
    return re.sub(r"\.(fastq|fq|fasta|fa)(\.gz)?$", "", os.path.basename(path))


def illumina_name(path: str) -> dict[str, str]:
    """name_sample_lane_read_number."""
    p = stem(path).split("_")
    return {"name": "_".join(p[:-4]), "sample": p[-4], "lane": p[-3], "read": p[-2], "number": p[-1]}


def element_name(path: str) -> dict[str, str]:
    """name_read."""
    p = stem(path).split("_")
    return {"name": "_".join(p[:-1]), "sample": "", "lane": "", "read": p[-1], "number": ""}


def name_fields(stems: Column, schema: str = "illumina") -> dict[str, Column]:
    """The same of a column of file stems."""
    p = F.split(stems, "_")
    n = 4 if schema == "illumina" else 1
    name = F.array_join(F.slice(p, F.lit(1), F.greatest(F.lit(0), F.size(p) - n)), "_")
    if schema != "illumina":
        return {"name": name, "read": F.try_element_at(p, F.lit(-1))}
    return {"name": name} | {k: F.try_element_at(p, F.lit(i)) for k, i in (("sample", -4), ("lane", -3), ("read", -2), ("number", -1))}


def group_paired_fastqs(path, schema: str = "illumina") -> dict[str, dict[str, tuple[str, str]]]:
    """Files of read 1 and 2 by sample name and lane; index reads are left out."""
    parse = {"illumina": illumina_name, "element": element_name}[schema]
    files = inputs(path) if isinstance(path, str) else list(path)
    found: dict[str, dict[str, dict[str, str]]] = defaultdict(lambda: defaultdict(dict))
    for f in files:
        at = parse(f)
        if at["read"] in ("R1", "R2"):
            found[at["name"]][at["lane"]][at["read"]] = f
    return {n: {lane: (r["R1"], r["R2"]) for lane, r in sorted(lanes.items(), key=lambda x: natural(x[0])) if len(r) == 2} for n, lanes in sorted(found.items(), key=lambda x: natural(x[0]))}


def _adapter(seq: str, adapter: str | None, p: MergeParams) -> int:
    """Where the adapter begins, the sequence's length if it isn't there: its seed, and no more than one base in eight amiss."""
    at = seq.find(adapter[: p.seed]) if adapter else -1
    while at >= 0:
        if sum(a != b for a, b in zip(seq[at:], adapter)) <= min(len(adapter), len(seq) - at) // 8:
            return at
        at = seq.find(adapter[: p.seed], at + 1)
    return len(seq)


def _trimmed(seq: str, qual: str, adapter: str | None, p: MergeParams) -> tuple[str, str]:
    at = _adapter(seq, adapter, p)
    seq, qual = seq[:at], qual[:at]
    q = np.frombuffer(qual.encode("latin-1"), dtype=np.uint8).astype(int) - 33
    end = len(q)
    while end >= p.window and q[end - p.window : end].mean() < p.quality:
        end -= 1
    return (seq[:end], qual[:end]) if end >= p.window else ("", "")


def merge_pair(seq1: str, qual1: str, seq2: str, qual2: str, p: MergeParams) -> tuple[str, str] | None:
    """Sequence and quality of a merged pair, None if the reads don't overlap; the better base of two wins."""
    a1, a2 = p.adapters or (None, None)
    (s1, q1), (s2, q2) = _trimmed(seq1, qual1, a1, p), _trimmed(seq2, qual2, a2, p)
    s2, q2 = revcomp_text(s2), q2[::-1]
    x, y = (np.frombuffer(s.encode("latin-1"), dtype=np.uint8) for s in (s1, s2))
    best = None
    for at in range(p.overlap - len(y), len(x) - p.overlap + 1):
        a, b = max(0, at), min(len(x), at + len(y))
        if b - a < p.overlap:
            continue
        bad = int((x[a:b] != y[a - at : b - at]).sum())
        if bad <= min(p.differences, (b - a) * p.percent / 100) and (best is None or (bad, a - b) < best[0]):
            best = ((bad, a - b), at, a, b)
    if best is None:
        return None
    _, at, a, b = best
    seq, qual = list(s1[:a]), list(q1[:a])
    for i in range(a, b):
        first = q1[i] >= q2[i - at]
        seq.append(s1[i] if first else s2[i - at])
        qual.append(q1[i] if first else q2[i - at])
    return "".join(seq) + s2[b - at :], "".join(qual) + q2[b - at :]


OUTCOME = READS + ", bases_in long, adapters int"


def pair_outcomes(first: DataFrame, second: DataFrame, params: MergeParams | None = None) -> DataFrame:
    """Every pair of two tables of reads with equal ids (a /1 or /2 at their ends doesn't count): merged, or with a null sequence; its bases and adapters."""
    p = params or MergeParams()
    key = F.regexp_replace("sequence_id", r"/[12]$", "")
    cols = ["sequence_input", "quality"]
    a = first.select(key.alias("sequence_id"), *[F.col(c).alias(f"{c}_1") for c in cols])
    b = second.select(key.alias("sequence_id"), *[F.col(c).alias(f"{c}_2") for c in cols])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s1, s2 = r["sequence_input_1"], r["sequence_input_2"]
                got = merge_pair(s1, r["quality_1"], s2, r["quality_2"], p) or (None, None)
                cut = sum(_adapter(s, x, p) < len(s) for s, x in zip((s1, s2), p.adapters or (None, None)))
                out.append({"sequence_id": r["sequence_id"], "sequence_input": got[0], "quality": got[1], "bases_in": len(s1) + len(s2), "adapters": cut})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("sequence_id", pa.string()), ("sequence_input", pa.string()), ("quality", pa.string()), ("bases_in", pa.int64()), ("adapters", pa.int32())]))

    return a.join(b, "sequence_id").mapInArrow(run, OUTCOME)


def merge_reads(first: DataFrame, second: DataFrame, params: MergeParams | None = None) -> DataFrame:
    """The pairs that merge."""
    return pair_outcomes(first, second, params).filter("sequence_input is not null").drop("bases_in", "adapters")


def split_interleaved(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read 1 and 2 of an interleaved table: of two equal ids, the one marked /1, or first, is read 1."""
    key = F.regexp_replace("sequence_id", r"/[12]$", "")
    w = Window.partitionBy("_k").orderBy(F.col("sequence_id"), F.col("_o"))
    rows = reads.withColumn("_k", key).withColumn("_o", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(w))
    cols = [F.col("_k").alias("sequence_id"), "sequence_input", "quality"]
    return rows.filter("_n = 1").select(*cols), rows.filter("_n = 2").select(*cols)


def merge_fastqs(spark: SparkSession, path, schema: str = "illumina", interleaved: bool = False, params: MergeParams | None = None) -> DataFrame:
    """Merged reads of all samples and lanes, with their sample."""
    return _all_outcomes(spark, path, schema, interleaved, params).filter("sequence_input is not null").drop("bases_in", "adapters")


def merge_report(spark: SparkSession, path, schema: str = "illumina", interleaved: bool = False, params: MergeParams | None = None) -> DataFrame:
    """Of each sample: pairs, merged, reads cut at an adapter, bases before, bases and mean quality of what merged."""
    rows = _all_outcomes(spark, path, schema, interleaved, params)
    scores = F.aggregate(F.transform(F.split("quality", "(?!$)"), lambda c: F.ascii(c) - 33), F.lit(0).cast("long"), lambda a, x: a + x)
    size = F.length("sequence_input")
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("pairs"), F.count("sequence_input").alias("merged"), F.sum("adapters").alias("adapters"), F.sum("bases_in").alias("bases_in"), F.sum(size).alias("bases_out"), (F.sum(scores) / F.sum(size)).alias("mean_quality"))


def _all_outcomes(spark: SparkSession, path, schema: str, interleaved: bool, params: MergeParams | None) -> DataFrame:
    out = None
    if interleaved:
        sets = [(stem(f), split_interleaved(read_fastx(spark, f))) for f in (inputs(path) if isinstance(path, str) else path)]
    else:
        sets = [(name, tuple(read_fastx(spark, f) for f in pair)) for name, lanes in group_paired_fastqs(path, schema).items() for pair in lanes.values()]
    for name, (a, b) in sets:
        some = pair_outcomes(a, b, params).withColumn("sample", F.lit(name))
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise ValueError("no read pairs")
    return out
