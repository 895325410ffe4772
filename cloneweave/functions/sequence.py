"""Nucleotide and amino acid expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons in TCAG order.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, product("TCAG", repeat=3)), AMINO))
# IUPAC codes and their complements.
IUPAC, COMPLEMENT = "ACGTRYKMBVDHN", "TGCAYRMKVBHDN"


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def codons(seq: Column, frame: int | Column = 1) -> Column:
    """Whole codons from a 1-based frame."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    return F.regexp_extract_all(F.substring(seq, frame, F.length(seq)), F.lit("(?s).{3}"), F.lit(0))


def translate(seq: Column, frame: int | Column = 1, dots: bool = False) -> Column:
    """Amino acids; X for an unknown codon, a point for three points if ``dots``."""
    table = CODONS | ({"...": "."} if dots else {})
    code = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(codons(seq, frame), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def translate_text(seq: str, frame: int = 1, dots: bool = False) -> str:
    """The same of a Python string."""
    s = seq[frame - 1 :]
    return "".join("." if dots and c == "..." else CODONS.get(c, "X") for c in (s[i : i + 3] for i in range(0, len(s) - 2, 3)))


def revcomp_text(seq: str) -> str:
    return seq.translate(str.maketrans(IUPAC, COMPLEMENT))[::-1]


def locus(call: Column) -> Column:
    return F.upper(F.substring(call, 1, 3))


def gene(call: Column) -> Column:
    return F.substring_index(call, "*", 1)


def species(call: Column, default: Column) -> Column:
    return F.when(F.instr(call, "__") > 0, F.substring_index(call, "__", -1)).otherwise(default)


def allele(call: Column) -> Column:
    return F.substring_index(call, "__", 1)


def heavy_like(call: Column) -> Column:
    return call.rlike("IGH|TRA|TRD")


def j_query(seq: Column, start: Column, end: Column) -> Column:
    """What is left of a read after a hit: before its end on the other strand, after it on this one."""
    return F.when(start > end, F.substring(seq, F.lit(1), end)).otherwise(F.substring(seq, end + 1, F.length(seq)))


def d_query(seq: Column, start: Column, end: Column) -> Column:
    return F.when(start > end, F.substring(seq, start + 1, F.length(seq))).otherwise(F.substring(seq, F.lit(1), start))


c_query = j_query
