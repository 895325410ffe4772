"""The engine's entry points.

``run`` reads, optionally merges pairs and finds UMIs, assigns, annotates and
writes or returns.  ``gl``, ``pp`` and ``tl`` group the germline, preprocessing
and tool functions.
"""

from __future__ import annotations

import json
import time
from types import SimpleNamespace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cloneweave.functions import sequence as S
from cloneweave.operators import annotate as A
from cloneweave.operators import assign, merge
from cloneweave.operators.umi import parse_umis, patterns
from cloneweave.sources import germline as G
from cloneweave.sources import sinks
from cloneweave.sources.fastx import reads_of

gl = SimpleNamespace(get_germline_database_path=G.get_germline_database_path, get_germline=G.get_germline, build_germline_database=G.build_germline_database, load=G.load)
pp = SimpleNamespace(merge_fastqs=merge.merge_fastqs, group_paired_fastqs=merge.group_paired_fastqs, merge_report=merge.merge_report)
tl = SimpleNamespace(parse_umis=parse_umis, build_germline_database=G.build_germline_database)


def annotate_reads(reads: DataFrame, germline: DataFrame, params: A.AnnotateParams | None = None, assigner: assign.Assigner = assign.assign) -> tuple[DataFrame, DataFrame]:
    """(annotated rows with ``error``, unassigned reads); persist the assignment's input where both are needed of a costly one."""
    calls = assigner(reads, germline)
    return A.annotate(assign.assigned(calls), germline, params), assign.unassigned(calls)


def run(
    spark: SparkSession,
    sequences,
    project_path: str | None = None,
    germline_database: str | DataFrame = "human",
    receptor: str = "bcr",
    output_format: str | tuple[str, ...] = "airr",
    umi_pattern=None,
    umi_length=None,
    merge: bool = False,
    merge_kwargs: dict | None = None,
    interleaved_fastq: bool = False,
    as_dataframe: bool = True,
    copy_inputs_to_project: bool = False,
    verbose: bool = False,
    debug: bool = False,
    germline_location: str | None = None,
    assigner: assign.Assigner = assign.assign,
):
    """Annotate a path, a sequence or an iterable of sequences.

    Without a project path, returns the annotated DataFrame of all samples, or
    its rows (one row alone as itself) if ``as_dataframe`` is false.  With one,
    writes airr/ and parquet/ as asked, unassigned/ and log/, each with a folder
    for every sample, log/summary (reads, annotated, seconds), and returns None.
    Read pairs are merged if ``merge`` or ``interleaved_fastq`` is set.  Sizes of
    chunks, threads and processes are Spark's.  ``assigner`` may be any function
    of reads and germline that returns the columns of an assignment.
    """
    from cloneweave.operators import merge as M

    formats = (output_format,) if isinstance(output_format, str) else tuple(output_format)
    if unknown := set(formats) - {"airr", "parquet"}:
        raise ValueError(f"output_format is airr or parquet, not {', '.join(sorted(unknown))}")
    germ = germline_database if isinstance(germline_database, DataFrame) else G.load(spark, germline_database, receptor, germline_location)
    name = "custom" if isinstance(germline_database, DataFrame) else germline_database
    began = time.time()
    if merge or interleaved_fastq:
        reads = M.merge_fastqs(spark, sequences, interleaved=interleaved_fastq, params=M.MergeParams(**(merge_kwargs or {})))
    else:
        reads = reads_of(spark, sequences)
    if copy_inputs_to_project and project_path:
        reads.write.parquet(f"{project_path}/input")
        reads = spark.read.parquet(f"{project_path}/input")
    reads = assign.spread(reads)
    umis = () if umi_pattern is None and umi_length is None else patterns(umi_pattern, umi_length)
    params = A.AnnotateParams(germline_database=name, umis=umis)
    if not project_path:
        good = A.succeeded(annotate_reads(reads, germ, params, assigner)[0])
        if as_dataframe:
            return good
        found = good.collect()
        return found[0] if len(found) == 1 else found
    seen, done = Observation(), Observation()
    calls = assigner(reads.observe(seen, F.count(F.lit(1)).alias("reads")), germ).persist(StorageLevel.DISK_ONLY)
    left = assign.unassigned(calls)
    rows = A.annotate(assign.assigned(calls), germ, params).observe(done, F.count(F.when(F.col("error").isNull(), 1)).alias("annotated"))
    rows = rows.persist(StorageLevel.DISK_ONLY)
    good = A.succeeded(rows)
    if "airr" in formats:
        sinks.write_airr(good, f"{project_path}/airr")
    if "parquet" in formats:
        sinks.write_parquet(good, f"{project_path}/parquet")
    sinks.write_unassigned(left, f"{project_path}/unassigned")
    sinks.write_log(A.failed(rows), f"{project_path}/log/failed")
    if debug:
        good.select("sequence_id").write.option("header", True).csv(f"{project_path}/log/succeeded")
    # counted while the results were made, without another scan
    summary = {**seen.get, **done.get, "seconds": round(time.time() - began, 3)}
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.text(f"{project_path}/log/summary")
    if verbose:
        print(f"{summary['reads']} reads, {summary['annotated']} annotated, {summary['reads'] / summary['seconds']:.1f} reads a second")
    rows.unpersist()
    calls.unpersist()
    return None


def register(spark: SparkSession) -> None:
    """SQL functions revcomp and translate_nt, and a table function kmers."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, '{S.IUPAC}', '{S.COMPLEMENT}'))")
    codes = ", ".join(f"'{c}', '{a}'" for c, a in S.CODONS.items())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION translate_nt(s STRING, frame INT) RETURNS STRING RETURN "
        "CASE WHEN length(s) - frame + 1 < 3 THEN '' ELSE array_join(transform(sequence(0, cast(floor((length(s) - frame + 1) / 3) as int) - 1), "
        f"i -> coalesce(try_element_at(map({codes}), substring(s, frame + 3 * i, 3)), 'X')), '') END"
    )

    @F.udtf(returnType="pos int, kmer string")
    class Kmers:
        def eval(self, seq: str, k: int):
            for i in range(len(seq) - k + 1):
                yield i, seq[i : i + k]

    spark.udtf.register("kmers", Kmers)
