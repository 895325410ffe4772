"""Positions in gapped, aligned and raw sequences.

Functions of Python strings serve the annotation kernel; their Column forms
run them over Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneweave.functions.rows import per_row


def gapped_index(gapped: str) -> list[int]:
    return [i + 1 for i, c in enumerate(gapped) if c != "."]


def gapped_from_raw_text(position: int, gapped: str, index: list[int] | None = None) -> int:
    index = gapped_index(gapped) if index is None else index
    if position > 0:
        return index[position - 1] if position <= len(index) else len(gapped)
    return 1 if gapped.startswith(".") else len(gapped)


def raw_from_gapped_text(position: int, gapped: str, germline_start: int = 0, sequence_start: int = 0) -> int:
    return max(0, position - gapped[:position].count(".") - (0 if position <= len(gapped) else position - len(gapped)) - germline_start - sequence_start)


def aligned_from_ungapped_text(position: int, aligned: str, is_end: bool = False) -> int | None:
    seen = -1
    for i, c in enumerate(aligned):
        seen += c != "-"
        if c != "-" and seen == position:
            while is_end and i + 1 < len(aligned) and aligned[i + 1] == "-":
                i += 1
            return i
    return None


def gapped_sequence_text(query: str, germline: str, gapped: str, germline_start: int) -> str:
    """The query with the germline's IMGT gaps; an insertion uses up gap columns of the germline."""
    out, cursor = [], gapped_from_raw_text(germline_start + 1, gapped) - 1
    for q, g in zip(query, germline):
        while g != "-" and cursor < len(gapped) and gapped[cursor] == ".":
            out.append(".")
            cursor += 1
        out.append(q)
        cursor += 1
    return "".join(out)


def gapped_from_raw(position: Column, gapped: Column) -> Column:
    """Column (1-based) of the raw position (1-based); the length beyond the end."""
    return per_row(gapped_from_raw_text, T.IntegerType(), position, gapped)


def raw_from_gapped(position: Column, gapped: Column, germline_start: Column, sequence_start: Column | int = 0) -> Column:
    """Bases up to a column, less what both sequences start with."""
    start = F.lit(sequence_start) if isinstance(sequence_start, int) else sequence_start
    return per_row(raw_from_gapped_text, T.IntegerType(), position, gapped, germline_start, start)


def aligned_from_ungapped(position: Column, aligned: Column, is_end: bool = False) -> Column:
    """Column (0-based) of a base (0-based); an end extends over the gaps that follow; null if there is none."""
    return per_row(aligned_from_ungapped_text, T.IntegerType(), position, aligned, F.lit(is_end))


def columns(seq: Column, gap: str) -> Column:
    """1-based columns of the characters that aren't the gap."""
    n = F.length(seq)
    return F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(1)) != gap)).otherwise(F.array().cast("array<int>"))


def ungapped_from_aligned(position: Column, aligned: Column) -> Column:
    """Bases before a column (0-based); null where the column is a gap."""
    return F.when(F.substring(aligned, position + 1, F.lit(1)) != "-", F.length(F.replace(F.substring(aligned, F.lit(1), position), F.lit("-"), F.lit(""))))


def query_from_reference(position: Column, query: Column, reference: Column) -> Column:
    """Offset in the query of the reference's base (0-based)."""
    col = F.get(columns(reference, "-"), position)
    return F.length(F.replace(F.substring(query, F.lit(1), col - 1), F.lit("-"), F.lit("")))


def raw_from_aligned(position: Column, reference: Column) -> Column:
    """Columns used up when so many reference bases are."""
    return F.when(position <= 0, F.lit(0)).otherwise(F.coalesce(F.get(columns(reference, "-"), position - 1), F.length(reference)))
