"""FASTA and FASTQ files as reads (sequence_id, sequence_input, quality).

The data source ``fastx`` plans byte ranges over plain files and one partition
over a gzip file.  A range owns the records that start in it.  A file's first
character says whether it is FASTA, whose records may have several lines, or
FASTQ, whose records have four.
"""

from __future__ import annotations

import gzip
import io
import os
import re
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cloneweave.schema import READS

# The extensions of input files.
EXTENSIONS = (".fasta", ".fa", ".fastq", ".fq", ".fasta.gz", ".fastq.gz")
RANGE = 64 << 20


def natural(name: str) -> list:
    """Sort key: digits by value."""
    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", name)]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"\w+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def sample_name(path: str) -> str:
    name = os.path.basename(path)
    name = name.removesuffix(".gz")
    return name.rpartition(".")[0] or name or "sequences"


def inputs(path: str) -> list[str]:
    """A file, or a folder's files of known extensions, also in folders below, in natural order."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise ValueError(f"{path} is no file or folder")
    found = [x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(EXTENSIONS)]
    scheme = re.match(r"\w+://", path)
    return sorted(((scheme[0] if scheme else "") + x for x in found), key=natural)


def records(lines: Iterable[tuple[int, str]], end: int | None = None, fastq: bool | None = None) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality) from (offset, line) pairs; no record starts at or after ``end``.

    Lines before the first header, and between FASTQ records, are left out.
    """
    it = iter(lines)
    line = next(it, None)
    while line is not None:
        at, text = line
        if end is not None and at >= end:
            return
        if fastq is None and text[:1] in "@>" and text:
            fastq = text[0] == "@"
        if fastq and text.startswith("@"):
            seq, _, qual = (next(it, (0, ""))[1] for _ in range(3))
            yield text[1:].split()[0] if text[1:].split() else "", seq.upper(), qual
            line = next(it, None)
        elif not fastq and text.startswith(">"):
            parts = []
            while (line := next(it, None)) is not None and not line[1].startswith(">"):
                parts.append(line[1])
            yield text[1:].split()[0] if text[1:].split() else "", "".join(parts).upper(), ""
        else:
            line = next(it, None)


def _lines(f, at: int) -> Iterator[tuple[int, str]]:
    for raw in iter(f.readline, b""):
        yield at, raw.decode().rstrip("\r\n")
        at += len(raw)


def _starts_record(lines: list[bytes], fastq: bool) -> bool:
    """Whether the first line starts a record: a header, in FASTQ with a plus sign two lines on and as many qualities as bases.

    A quality line may begin with any of these characters; but two lines after it stands a sequence.
    """
    if not fastq:
        return lines[0].startswith(b">")
    bare = [x.rstrip(b"\r\n") for x in lines]
    return bare[0].startswith(b"@") and bare[2].startswith(b"+") and len(bare[1]) == len(bare[3])


def _is_fastq(f) -> bool:
    """By the first character that is no white space."""
    while (c := f.read(1)).isspace():
        pass
    return c == b"@"


class FastxRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None):
        self.path, self.begin, self.end = path, begin, end


class Fastx(DataSource):
    """Options: path (file or folder), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return READS + ", sample string"

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(self.options)


class FastxReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.step = inputs(options["path"]), int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[FastxRange]:
        out = []
        for path in self.paths:
            if path.endswith(".gz"):
                out.append(FastxRange(path, 0, None))
                continue
            system, at = opened(path)
            size = system.get_file_info(at).size
            out += [FastxRange(path, a, min(size, a + self.step)) for a in range(0, size, self.step)]
        return out

    def read(self, part: FastxRange | None) -> Iterator[tuple]:
        if part is None:  # what Spark passes where there is no partition
            return
        system, at = opened(part.path)
        name = sample_name(part.path)
        if part.end is None:
            with gzip.open(system.open_input_stream(at, compression=None)) as f:
                yield from ((*r, name) for r in records(_lines(f, 0)))
            return
        with system.open_input_file(at) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            fastq = _is_fastq(f)
            begin = part.begin
            f.seek(begin)
            if begin:
                f.seek(begin - 1)
                f.readline()
                begin = f.tell()
                while begin < part.end:
                    ahead = [f.readline() for _ in range(4 if fastq else 1)]
                    if not ahead[0] or _starts_record(ahead, fastq):
                        break
                    begin += len(ahead[0])
                    f.seek(begin)
                f.seek(begin)
            if begin < part.end:
                yield from ((*r, name) for r in records(_lines(f, begin), part.end, fastq))


def read_fastx(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Reads of a file or folder with their sample's name; a quality's leading quote character becomes #."""
    spark.dataSource.register(Fastx)
    rows = spark.read.format("fastx").option("rangeBytes", range_bytes).load(path)
    return rows.withColumn("quality", F.regexp_replace(F.coalesce("quality", F.lit("")), "^[\"']", "#"))


def is_path(text: str) -> bool:
    return os.path.exists(text) or bool(re.match(r"\w+:/", text))


def reads_of(spark: SparkSession, sequences) -> DataFrame:
    """Reads of a path, of one sequence, or of an iterable of sequences or (id, sequence[, quality]) tuples."""
    if isinstance(sequences, DataFrame):
        return sequences
    if isinstance(sequences, str):
        if is_path(sequences):
            return read_fastx(spark, sequences)
        sequences = [sequences]
    try:
        items = list(sequences)
    except TypeError:
        raise ValueError(f"{sequences!r} is no path, sequence or iterable of them") from None
    rows = []
    for i, x in enumerate(items):
        t = (f"sequence{i}", x) if isinstance(x, str) else tuple(x)
        if len(t) not in (2, 3) or not all(isinstance(v, str) for v in t):
            raise ValueError(f"{x!r} is no sequence")
        rows.append((t[0], t[1].upper(), t[2] if len(t) > 2 else ""))
    return spark.createDataFrame(rows, READS).withColumn("sample", F.lit("sequences"))


def write_fasta(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit(">"), "sequence_id", F.lit("\n"), "sequence_input")).write.text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit("@"), "sequence_id", F.lit("\n"), "sequence_input", F.lit("\n+\n"), "quality")).write.text(path)
