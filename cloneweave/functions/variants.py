"""Mutations and indels in IMGT numbering: ``6:A>T``, ``5:3>GGG``, ``3-4:2>GC!``.

Each is one function of Python strings, linear in their length, that the
annotation kernel calls; the Column forms run the same function over Arrow batches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneweave.functions.positions import gapped_from_raw_text, gapped_index
from cloneweave.functions.rows import per_row

LIST = T.ArrayType(T.StringType())


def mutations_text(query: str, germline: str, gapped: str, start: int) -> list[str]:
    index, raw, out = gapped_index(gapped), start, []
    for q, g in zip(query, germline):
        raw += g != "-"
        if q != g and "-" not in (q, g):
            out.append(f"{gapped_from_raw_text(raw, gapped, index)}:{g}>{q}")
    return out


def indels_text(query: str, germline: str, gapped: str, start: int, kind: str) -> list[str]:
    index, out = gapped_index(gapped), []
    held, other = (germline, query) if kind == "insertion" else (query, germline)
    for m in re.finditer("-+", held):
        n, seq = len(m[0]), other[m.start() : m.end()]
        raw = start + len(germline[: m.start()].replace("-", "")) + (kind == "deletion")
        at = gapped_from_raw_text(raw, gapped, index) if raw > 0 else len(gapped)
        span = f"{at}-{at + n - 1}" if kind == "deletion" and n > 1 else f"{at}"
        out.append(f"{span}:{n}>{seq}{'!' if n % 3 else ''}")
    return out


def mutation_list(query: Column, germline: Column, gapped: Column, start: Column) -> Column:
    """Array of notations."""
    return per_row(mutations_text, LIST, query, germline, gapped, start)


def mutation_structs(notations: Column) -> Column:
    """Array of struct(position, germline, sequence)."""
    part = lambda m, i: F.regexp_extract(m, r"^(\d+):(.)>(.)$", i)
    return F.transform(notations, lambda m: F.struct(part(m, 1).cast("int").alias("position"), part(m, 2).alias("germline"), part(m, 3).alias("sequence")))


def mutations(query: Column, germline: Column, gapped: Column, start: Column) -> Column:
    return F.array_join(mutation_list(query, germline, gapped, start), "|")


def insertions(query: Column, germline: Column, gapped: Column, start: Column) -> Column:
    return F.array_join(per_row(lambda *x: indels_text(*x, "insertion"), LIST, query, germline, gapped, start), "|")


def deletions(query: Column, germline: Column, gapped: Column, start: Column) -> Column:
    return F.array_join(per_row(lambda *x: indels_text(*x, "deletion"), LIST, query, germline, gapped, start), "|")


def indel_length(notation: Column) -> Column:
    """Sum of the lengths in a notation."""
    parts = F.filter(F.split(notation, r"\|"), lambda x: x != "")
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.regexp_extract(x, ":(\\d+)>", 1).cast("int"))


def frameshift(ins: Column, dels: Column) -> Column:
    return (indel_length(ins) - indel_length(dels)) % 3 != 0


def identity(count: Column, length: Column) -> Column:
    return F.when(length > 0, 1 - count / length)
