"""Germline assignment: seeds, diagonals, exact rescoring, best hits, the chain of V, J, D and C.

Similarity search runs inside Arrow batches of reads against a k-mer index of
the germline, which every worker builds once from a broadcast table.  K-mers of
a query's strands meet the index; matches on one diagonal are counted; the
alleles with the most go to a batched local alignment, and the best hit is the
one of most identities, then smallest e-value, then smallest name.  A read
takes all its searches in one task: nothing is shuffled, whatever the number of
reads, and equal read ids don't meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cloneweave.functions.sequence import d_query, heavy_like, j_query, revcomp_text
from cloneweave.operators.align import Params, align
from cloneweave.schema import ASSIGNMENT, HITS

MOST_ALLELES = 200_000


@dataclass(frozen=True)
class SearchParams:
    k: int = 7
    max_seqs: int = 25
    max_evalue: float = 1000.0
    min_aln_len: int = 12
    strands: tuple[bool, ...] = (False, True)
    scoring: Params = Params(match=2, mismatch=-3, gap_open=-5, gap_extend=-2)


# Seeds are as short as recall needs: tests plant mutated J and D genes.
V, J, D, C = SearchParams(), SearchParams(k=5), SearchParams(k=3, min_aln_len=5, max_evalue=1e6), SearchParams(max_evalue=10.0)
J_LEAST, D_SPAN = 14, 5  # bases of a J query, and of a J hit's span for a D query
# Karlin-Altschul constants for these scores: estimates, so supports compare only with each other.
LAMBDA, KAPPA = 0.625, 0.41
_CODE = np.full(256, 4, dtype=np.int64)
_CODE[list(b"ACGT")] = range(4)


class Hit(NamedTuple):
    """Coordinates are 1-based; start > end on the other strand."""

    target: str
    evalue: float
    start: int
    end: int
    identities: int


def kmer_codes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (0-based) and codes of the k-mers without other letters than A, C, G and T."""
    x = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]
    n = len(x) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, bad = np.zeros(n, dtype=np.int64), np.concatenate(([0], np.cumsum(x > 3)))
    for j in range(k):
        code = code * 4 + (x[j : j + n] & 3)
    at = np.flatnonzero(bad[k:] == bad[:n])
    return at, code[at]


class Index:
    """The k-mers of named sequences, by code."""

    def __init__(self, alleles: Iterable[tuple], p: SearchParams):
        self.p, rows = p, sorted(alleles)
        self.names, self.seqs = [r[0] for r in rows], [r[1] for r in rows]
        self.letters = max(1, sum(map(len, self.seqs)))
        found = [kmer_codes(s, p.k) for s in self.seqs]
        code = np.concatenate([c for _, c in found] or [np.zeros(0, np.int64)])
        order = np.argsort(code, kind="stable")
        self.place = np.concatenate([a for a, _ in found] or [np.zeros(0, np.int64)])[order]
        self.owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in found])[order]
        self.bounds = np.searchsorted(code[order], np.arange(4**p.k + 1))
        self.longest = max(map(len, self.seqs), default=0)

    def diagonals(self, seq: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Allele number, diagonal and count of matches, in order of alleles and diagonals."""
        at, code = kmer_codes(seq, self.p.k)
        first = self.bounds[code]
        count = self.bounds[code + 1] - first
        total = int(count.sum())
        each = np.repeat(np.arange(len(at)), count)
        spot = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + first[each]
        width = len(seq) + self.longest + 1
        key, n = np.unique(self.owner[spot] * width + at[each] - self.place[spot] + self.longest, return_counts=True)
        return key // width, key % width - self.longest, n

    def candidates(self, seq: str, most: int | None = None) -> list[tuple[int, int, bool]]:
        """Allele number, count of its best diagonal and strand of the alleles with the best ones; forward and then names go first."""
        best, back = np.zeros(len(self.names), np.int64), np.zeros(len(self.names), bool)
        for reverse in self.p.strands:
            owner, _, n = self.diagonals(revcomp_text(seq) if reverse else seq)
            top = np.zeros_like(best)
            np.maximum.at(top, owner, n)
            back = np.where(top > best, reverse, back)
            best = np.maximum(best, top)
        order = np.argsort(-best, kind="stable")[: most or self.p.max_seqs]
        return [(int(i), int(best[i]), bool(back[i])) for i in order if best[i]]


def hits(seqs: list[str | None], index: Index) -> list[list[Hit]]:
    """All hits of each sequence, by local alignment with its candidates; a null sequence has none."""
    p = index.p
    pairs, of = [], []
    for i, s in enumerate(seqs):
        if s:
            turned = revcomp_text(s)
            for allele, _, reverse in index.candidates(s):
                pairs.append((turned if reverse else s, index.seqs[allele]))
                of.append((i, allele, reverse))
    out: list[list[Hit]] = [[] for _ in seqs]
    for (i, allele, reverse), a in zip(of, align(pairs, "local", p.scoring)):
        n = len(a.query)
        evalue = KAPPA * n * index.letters * exp(-min(700.0, LAMBDA * a.score))
        if len(a.aligned_query) < p.min_aln_len or evalue > p.max_evalue:
            continue
        start, end = (n - a.query_begin, n - a.query_end) if reverse else (a.query_begin + 1, a.query_end + 1)
        out[i].append(Hit(index.names[allele], evalue, start, end, a.identities))
    return out


def best(found: list[Hit]) -> Hit | None:
    """Most identities, then smallest e-value, then smallest name."""
    return min(found, key=lambda h: (-h.identities, h.evalue, h.target), default=None)


def after(seq: str, h: Hit) -> str:
    """What is left of a read after a hit: before its end on the other strand, after it on this one."""
    return seq[: h.end] if h.start > h.end else seq[h.end :]


def before(seq: str, h: Hit) -> str:
    return seq[h.start :] if h.start > h.end else seq[: h.start]


def is_heavy(call: str) -> bool:
    return any(x in call for x in ("IGH", "TRA", "TRD"))


def assign_reads(seqs: list[str], indexes: dict[str, Index]) -> list[tuple[Hit | None, ...]]:
    """Best V, J, D and C hit of each read; each search takes what the ones before left."""
    some = lambda queries, seg: [best(x) for x in hits(queries, indexes[seg])]
    v = some(seqs, "v")
    rest = [after(s, h) if h else None for s, h in zip(seqs, v)]
    j = some([s if s and len(s) >= J_LEAST else None for s in rest], "j")
    d = some([before(s, h) if h and is_heavy(x.target) and abs(h.start - h.end) >= D_SPAN else None for s, h, x in zip(rest, j, v)], "d")
    c = some([after(s, h) if h else None for s, h in zip(rest, j)], "c")
    return list(zip(v, j, d, c))


def _collected(germline: DataFrame, *columns: str) -> list[tuple]:
    """A germline is a reference of a few thousand alleles; larger tables are refused."""
    rows = germline.select(*columns).limit(MOST_ALLELES + 1).collect()
    if len(rows) > MOST_ALLELES:
        raise ValueError(f"a germline database has at most {MOST_ALLELES:,} alleles")
    return [tuple(r) for r in rows]


def _searched(queries: DataFrame, germline: DataFrame, p: SearchParams, rows_of, columns: dict[str, str]) -> DataFrame:
    """What ``rows_of`` (index, sequences) gives for each query, beside its key."""
    shared = queries.sparkSession.sparkContext.broadcast(_collected(germline, "allele", "seq"))
    kinds = {"query": dict(queries.dtypes)["query"]} | {c: dict(germline.dtypes)["allele"] if t == "allele" else t for c, t in columns.items()}
    schema = T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in kinds.items()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, p)
        for b in batches:
            for first in range(0, b.num_rows, 256):
                some = b.slice(first, 256)
                found = rows_of(index, some["seq"].to_pylist())
                rows = [(key, *r) for key, rs in zip(some["query"].to_pylist(), found) for r in rs]
                cols = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, arrow.types)], schema=arrow)

    return queries.select("query", "seq").mapInArrow(run, schema)


def seeds(queries: DataFrame, germline: DataFrame, p: SearchParams) -> DataFrame:
    """query, strand (true: reverse), allele, diagonal, n: k-mer matches on each diagonal of queries (query, seq)."""

    def rows_of(index: Index, seqs: list[str]):
        for s in seqs:
            yield [(reverse, index.names[a], int(d), int(n)) for reverse in p.strands for a, d, n in zip(*index.diagonals(revcomp_text(s) if reverse else s))]

    return _searched(queries, germline, p, rows_of, {"strand": "boolean", "allele": "allele", "diagonal": "int", "n": "long"})


def candidates(queries: DataFrame, germline: DataFrame, p: SearchParams, most: int | None = None) -> DataFrame:
    """query, allele, n, strand: the alleles of each query with the best diagonals."""
    rows_of = lambda index, seqs: [[(index.names[a], n, back) for a, n, back in index.candidates(s, most)] for s in seqs]
    return _searched(queries, germline, p, rows_of, {"allele": "allele", "n": "long", "strand": "boolean"})


def search(queries: DataFrame, germline: DataFrame, p: SearchParams) -> DataFrame:
    """Hits of queries (query, seq) among alleles (allele, seq)."""

    def rows_of(index: Index, seqs: list[str]):
        return [[(h.target, h.evalue, h.start, h.end, s, h.identities) for h in found] for s, found in zip(seqs, hits(seqs, index))]

    names = [x.strip().split(" ") for x in HITS.split(",")][1:]
    return _searched(queries, germline, p, rows_of, {c: "allele" if c == "target" else t for c, t in names})


def best_hit(hits: DataFrame) -> DataFrame:
    """One hit a query: most identities, then smallest e-value, then smallest name."""
    key = F.struct((-F.col("nident")).alias("a"), F.col("evalue").alias("b"), F.col("target").alias("c"))
    every = F.struct(*[c for c in hits.columns if c != "query"])
    return hits.groupBy("query").agg(F.min_by(every, key).alias("h")).select("query", "h.*")


def j_queries(v: DataFrame, least: int = J_LEAST) -> DataFrame:
    """The J queries of a table of V hits."""
    seq = j_query(F.col("v_qseq"), F.col("v_qstart"), F.col("v_qend"))
    return v.select(F.col("v_query").alias("query"), seq.alias("seq")).filter(F.length("seq") >= least)


def d_queries(vj: DataFrame, least: int = D_SPAN) -> DataFrame:
    """Of heavy-like reads with a J hit; ``least`` holds for the J hit's span."""
    rows = vj.filter(heavy_like(F.col("v_call")) & F.col("j_query").isNotNull() & (F.abs(F.col("j_qstart") - F.col("j_qend")) >= least))
    return rows.select(F.col("v_query").alias("query"), d_query(F.col("j_qseq"), F.col("j_qstart"), F.col("j_qend")).alias("seq")).filter("seq <> ''")


class Assigner(Protocol):
    """What takes reads (sequence_id, sequence_input, quality) and a germline table to the columns of ``ASSIGNMENT``.

    A column ``sample`` of the reads is kept.  Any such function may be given to
    ``api.run`` and ``api.annotate_reads`` in place of ``assign``.
    """

    def __call__(self, reads: DataFrame, germline: DataFrame) -> DataFrame: ...


def assign(reads: DataFrame, germline: DataFrame) -> DataFrame:
    """Calls and supports of every read: ``reads`` (sequence_id, sequence_input, quality), ``germline`` (segment, allele, seq).

    Rows without a V or J call have null there; see ``assigned``.  A null
    sequence has no call.
    """
    shared = reads.sparkSession.sparkContext.broadcast(_collected(germline, "segment", "allele", "seq"))
    more = [c for c in reads.columns if c == "sample"]
    schema = T.StructType.fromDDL(ASSIGNMENT + "".join(f", {c} string" for c in more))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = {s: Index([r[1:] for r in shared.value if r[0] == s], p) for s, p in (("v", V), ("j", J), ("d", D), ("c", C))}
        for b in batches:
            for first in range(0, b.num_rows, 256):
                some = b.slice(first, 256)
                seqs = [(s or "").upper() for s in some["sequence_input"].to_pylist()]
                found = assign_reads(seqs, indexes)
                of = {c: some[c] for c in some.schema.names} | {"rev_comp": [v and v.start > v.end for v, *_ in found]}
                for n, seg in enumerate("vjdc"):
                    of |= {f"{seg}_call": [h[n] and h[n].target for h in found], f"{seg}_support": [h[n] and h[n].evalue for h in found]}
                yield pa.record_batch([c if isinstance(c := of[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    return reads.select("sequence_id", "sequence_input", "quality", *more).mapInArrow(run, schema)


def spread(reads: DataFrame) -> DataFrame:
    """Reads over as many tasks as there are cores, at least: a read's searches cost far more than to move it, and a gzip file is one task."""
    n = reads.sparkSession.sparkContext.defaultParallelism
    return reads.repartition(n) if reads.rdd.getNumPartitions() < n else reads


def assigned(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("v_call").isNotNull() & F.col("j_call").isNotNull())


def unassigned(rows: DataFrame) -> DataFrame:
    """Reads without a V or J call, with their sample if they have one."""
    columns = ["sequence_id", "sequence_input", *(c for c in rows.columns if c == "sample")]
    return rows.filter(F.col("v_call").isNull() | F.col("j_call").isNull()).select(*columns)
