"""Unique molecular identifiers found by aligned flanks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cloneweave.functions.sequence import revcomp_text
from cloneweave.operators.align import Params, align
from cloneweave.sources.fastx import is_path, reads_of, write_fasta, write_fastq

MARK = "[UMI]"
SCORING = Params(gap_open=-20, gap_extend=-20)
# The built-in pattern's flanks, its length and its mismatches.
BUILT_IN = {"smartseq-human-bcr": (["[UMI]TCAGCGGGAAGACATT", "[UMI]GGGCGGATGGACTACC", "[UMI]CCGATGGGCGCTTGGT", "[UMI]GGAACACATGCGGAGC"], 12, 2)}


@dataclass(frozen=True)
class UmiPattern:
    """``pattern`` has flanks around [UMI], or is None for the first (or, negative length, last) bases."""

    pattern: str | None
    length: int | None = None
    mismatches: int = 1


def patterns(pattern: str | Sequence[str] | None, length: int | Sequence[int] | None, mismatches: int | None = None) -> tuple[UmiPattern, ...]:
    """Patterns and lengths as given by a caller: one or lists of equal length; a built-in brings its own length and mismatches."""
    if isinstance(pattern, str) and pattern in BUILT_IN:
        flanks, n, most = BUILT_IN[pattern]
        return tuple(UmiPattern(x, length if isinstance(length, int) else n, most if mismatches is None else mismatches) for x in flanks)
    ps = [pattern] if pattern is None or isinstance(pattern, str) else list(pattern)
    ls = [length] if length is None or isinstance(length, int) else list(length)
    ls = ls * len(ps) if len(ls) == 1 else ls
    ps = ps * len(ls) if len(ps) == 1 else ps
    if len(ps) != len(ls):
        raise ValueError("as many lengths as patterns are needed")
    for x, n in zip(ps, ls):
        if x is None and n is None or x is not None and MARK not in x.upper():
            raise ValueError("a pattern with [UMI], or a length, is needed")
    return tuple(UmiPattern(x, n, 1 if mismatches is None else mismatches) for x, n in zip(ps, ls))


def _flanks(seqs: list[str], flank: str, most: int) -> list:
    """Alignments of a flank with each sequence, None where it has more mismatches; all Nones for an empty flank."""
    if not flank:
        return [None] * len(seqs)
    found = iter(align([(flank, s) for s in seqs if s], "local", SCORING))
    out = [next(found) if s else None for s in seqs]
    return [a if a and len(flank) - a.identities <= most and a.score > 0 else None for a in out]


def find_all(seqs: Sequence[str], p: UmiPattern) -> list[str | None]:
    """The pattern's UMI of each sequence; flanks of all are aligned in batches."""
    if p.pattern is None:
        return [(s[: p.length] if p.length >= 0 else s[p.length :]) or None for s in seqs]
    seqs = [revcomp_text(s) if p.length is not None and p.length < 0 else s for s in seqs]
    lead, _, trail = p.pattern.upper().partition(MARK)
    n = None if p.length is None else abs(p.length)
    return [_between(s, lead, a, trail, b, n) for s, a, b in zip(seqs, _flanks(seqs, lead, p.mismatches), _flanks(seqs, trail, p.mismatches))]


def _between(seq: str, lead: str, a, trail: str, b, n: int | None) -> str | None:
    if not seq or (lead and a is None) or (trail and b is None):
        return None
    if lead and trail:
        return seq[a.target_end + 1 : b.target_begin] or None
    if lead:
        got = seq[a.target_end + 1 :] if n is None else seq[a.target_end + 1 : a.target_end + 1 + n]
        return got if n is None or len(got) == n else None
    start = 0 if n is None else b.target_begin - n
    return seq[start : b.target_begin] or None if start >= 0 else None


def find_umi(seq: str, p: UmiPattern) -> str | None:
    return find_all([seq], p)[0]


def find_all_umis(seqs: Sequence[str], ps: Sequence[UmiPattern]) -> list[str | None]:
    """UMIs of all patterns that a sequence has one of, with + between."""
    return ["+".join(x for x in found if x) or None for found in zip(*(find_all(seqs, p) for p in ps))]


def find_umis(seq: str, ps: Sequence[UmiPattern]) -> str | None:
    return find_all_umis([seq], ps)[0]


def parse_umis(sequences, pattern=None, length=None, mismatches: int | None = None, drop: bool = True, output_file: str | None = None, fmt: str = "fasta", spark: SparkSession | None = None) -> DataFrame | Row | None:
    """Reads with a ``umi`` column and, where one was found, ``_UMI`` after their id.

    ``sequences`` is a table of reads, a path, an iterable, or one sequence or
    (id, sequence) pair.  Reads without a UMI are dropped unless ``drop`` is
    false; one sequence alone is returned as a row whatever was found.  With an
    output file, reads are written there as FASTA or FASTQ, and None is
    returned; input files are never changed.
    """
    ps = patterns(pattern, length, mismatches)
    if fmt not in ("fasta", "fastq"):
        raise ValueError(f"fmt is fasta or fastq, not {fmt}")
    one = isinstance(sequences, tuple) and 2 <= len(sequences) <= 3 and all(isinstance(x, str) for x in sequences) or isinstance(sequences, str) and not is_path(sequences)
    if isinstance(sequences, DataFrame):
        reads = sequences
    else:
        reads = reads_of(spark or SparkSession.builder.getOrCreate(), [sequences] if one else sequences)

    @F.arrow_udf("string")
    def found(seqs: pa.Array) -> pa.Array:
        return pa.array(find_all_umis([(s or "").upper() for s in seqs.to_pylist()], ps), pa.string())

    out = reads.withColumn("umi", found(F.col("sequence_input")))
    out = out.withColumn("sequence_id", F.when(F.col("umi").isNotNull(), F.concat("sequence_id", F.lit("_"), "umi")).otherwise(F.col("sequence_id")))
    if one and not output_file:
        return out.first()
    out = out.filter("umi is not null") if drop else out
    if not output_file:
        return out
    (write_fasta if fmt == "fasta" else write_fastq)(out, output_file)
    return None
