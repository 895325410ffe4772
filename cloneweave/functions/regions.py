"""IMGT regions, masks and productivity.

Functions of Python strings serve the annotation kernel; their Column forms
run them over Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneweave.functions.rows import per_row

REGIONS = ["fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"]
# IMGT bounds of the regions, 1-based, inclusive; nucleotides, amino acids.
NT_BOUNDS = {"fwr1": (1, 78), "cdr1": (79, 114), "fwr2": (115, 165), "cdr2": (166, 195), "fwr3": (196, 312), "cdr3": (313, 351), "fwr4": (352, 387)}
AA_BOUNDS = {"fwr1": (1, 26), "cdr1": (27, 38), "fwr2": (39, 55), "cdr2": (56, 65), "fwr3": (66, 104), "cdr3": (105, 117), "fwr4": (118, 129)}


def region_of_gapped(gapped: Column, region: str, aa: bool = False) -> Column:
    """A region of an IMGT-gapped sequence, without its gaps."""
    a, b = (AA_BOUNDS if aa else NT_BOUNDS)[region]
    return F.translate(F.substring(gapped, a, b - a + 1), ".-", "")


# Digits of a mask, loci whose junction ends with W, and texts of issues.
DIGITS = {"cdr1": "1", "cdr2": "2", "cdr3": "3"}
TRYPTOPHAN = ("IGH", "TRA", "TRD")
SHIFT, STOP, AMBIGUOUS = "out-of-frame indel(s)", "stop codon(s)", "ambiguous nucleotide(s)"
MISMATCH = "V/J locus mismatch ({} and {})"
NO_START, NO_END = "junction does not start with conserved C", "junction does not end with conserved {}"


def cdr_mask_text(*regions: str | None) -> str:
    """0 for framework, 1 to 3 for the CDRs; ``regions`` in the order of REGIONS."""
    return "".join(DIGITS.get(r, "0") * len(x or "") for r, x in zip(REGIONS, regions))


def segment_mask_text(before: str, v_length: int, v: str | None, n1: str | None, d: str | None, n2: str | None, j: str | None, j_length: int, fwr4: str | None, cdr3: str | None = None) -> str:
    """V, N, D and J of each position.

    ``before``: all regions before CDR3; the rest of it is CDR3's parts and
    FWR4.  In amino acids ``cdr3`` is given, and what the mask has beyond it is
    taken off FWR4; in nucleotides FWR4 has as many as the J gene at most.
    """
    head = len(before)
    mask = "V" * min(v_length, head) + "N" * max(0, head - v_length)
    for part, letter in ((v, "V"), (n1, "N"), (d, "D"), (n2, "N"), (j, "J")):
        mask += letter * len(part or "")
    tail = len(fwr4 or "")
    return mask + "J" * (min(j_length, tail) if cdr3 is None else max(0, tail - max(0, len(mask) - head - len(cdr3))))


def nongermline_text(query: str, germline: str, segments: str) -> str:
    """1 where a base is not the germline's or lies in N; columns where the query has a gap are left out."""
    out: list[str] = []
    for q, g in zip(query, germline):
        if len(out) == len(segments):
            break
        if q != "-":
            out.append("1" if segments[len(out)] == "N" or q != g else "0")
    return "".join(out)


def productivity_text(sequence: str, sequence_aa: str, v_call: str, j_call: str, junction_aa: str | None, loc: str | None, shifted: bool, tryptophan: tuple[str, ...] = TRYPTOPHAN) -> list[str]:
    """What makes a sequence non-productive, in order."""
    out = [SHIFT] if shifted else []
    if "*" in sequence_aa:
        out.append(STOP)
    if "N" in sequence:
        out.append(AMBIGUOUS)
    if v_call[:3] != j_call[:3]:
        out.append(MISMATCH.format(v_call, j_call))
    if junction_aa:
        if junction_aa[0] != "C":
            out.append(NO_START)
        ends = "W/F" if loc is None else "W" if loc.upper() in tryptophan else "F"
        if junction_aa[-1] not in ends.split("/"):
            out.append(NO_END.format(ends))
    return out


def cdr_mask(regions: dict[str, Column]) -> Column:
    return per_row(cdr_mask_text, T.StringType(), *(regions[r] for r in REGIONS), nulls=True)


def mask_array(mask: Column) -> Column:
    """A digit mask as integers, a letter mask as single letters."""
    return F.filter(F.split(mask, ""), lambda x: x != "")


def segment_mask(before: Column, v_length: Column, v: Column, n1: Column, d: Column, n2: Column, j: Column, j_length: Column, fwr4: Column, cdr3: Column | None = None) -> Column:
    return per_row(segment_mask_text, T.StringType(), before, v_length, v, n1, d, n2, j, j_length, fwr4, F.lit(None).cast("string") if cdr3 is None else cdr3, nulls=True)


def nongermline_mask(query: Column, germline: Column, segments: Column) -> Column:
    return per_row(nongermline_text, T.StringType(), query, germline, segments)


def productivity_issues(sequence: Column, sequence_aa: Column, v_call: Column, j_call: Column, junction_aa: Column, loc: Column, shifted: Column) -> Column:
    return per_row(productivity_text, T.ArrayType(T.StringType()), sequence, sequence_aa, v_call, j_call, junction_aa, loc, shifted, nulls=True)
