"""Unique molecular identifiers with exact flanks, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def umi_slice(seq: Column, length: int) -> Column:
    """The first bases, or the last ones for a negative length."""
    return F.substring(seq, 1, length) if length >= 0 else F.right(seq, F.lit(-length))


def umi_exact(seq: Column, leading: str = "", trailing: str = "", length: int | None = None) -> Column:
    """Bases after ``leading``, before ``trailing``, or between both; null where a flank or base is missing."""
    if leading and trailing:
        at = F.instr(seq, leading)
        rest = F.substring(seq, at + len(leading), F.length(seq))
        to = F.instr(rest, trailing)
        return F.when((at > 0) & (to > 0), F.substring(rest, F.lit(1), to - 1))
    if leading:
        at = F.instr(seq, leading)
        got = F.substring(seq, at + len(leading), F.lit(length))
        return F.when((at > 0) & (F.length(got) == length), got)
    at = F.instr(seq, trailing)
    if length is None:
        return F.when(at > 0, F.substring(seq, F.lit(1), at - 1))
    return F.when(at > length, F.substring(seq, at - length, F.lit(length)))


def joined(*umis: Column) -> Column:
    """Those found, with + between; null where none was."""
    found = F.filter(F.array(*umis), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, "+"))
