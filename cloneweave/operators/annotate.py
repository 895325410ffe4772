"""Annotation of assigned reads.

One read's annotation is a generator that asks for alignments; ``annotate_rows``
runs the reads of an Arrow batch in step, so that each round's alignments of
all reads are made in one batch.  Everything else is per read string work.  A
read that can't be annotated keeps its input columns and an ``error``.

``compat`` keeps three oddities of the format's origin: a J germline end that
overshoots when the alignment starts inside the J gene, a C start counted
twice, and a translation of the gapped C in the V gene's frame.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cloneweave.functions import regions as R
from cloneweave.functions.positions import aligned_from_ungapped_text, gapped_from_raw_text, gapped_sequence_text, raw_from_gapped_text
from cloneweave.functions.sequence import revcomp_text, translate_text
from cloneweave.functions.variants import indels_text, mutations_text
from cloneweave.operators.align import Alignment, Params, align
from cloneweave.operators.umi import UmiPattern, find_umis
from cloneweave.schema import FAILED, OUTPUT_COLUMNS

HEAVY = R.TRYPTOPHAN
# IMGT columns of FR3 in a gapped V gene, and bases of FR4 at the end of a J gene.
FR3 = slice(195, 312)
FR4_HEAVY, FR4_LIGHT = 34, 31


@dataclass(frozen=True)
class AnnotateParams:
    scoring: Params = Params()
    j_semiglobal_open: int = -20
    j_local_open: int = -15
    realign_open: int = -2
    d_loci: tuple[str, ...] = HEAVY
    tryptophan_loci: tuple[str, ...] = HEAVY
    compat: bool = True
    umis: tuple[UmiPattern, ...] = ()
    germline_database: str = "human"


@dataclass(frozen=True)
class Ask:
    pairs: tuple[tuple[str, str], ...]
    mode: str
    params: Params


class Germlines:
    """Alleles by name, segment by segment: a few thousand short strings a worker."""

    def __init__(self, rows: Iterable[dict]):
        self.seq, self.gapped, self.of = {}, {}, {s: [] for s in "vdjc"}
        for r in rows:
            self.seq[r["allele"]], self.gapped[r["allele"]] = r["seq"], r["gapped"] or r["seq"]
            self.of[r["segment"]].append(r["allele"])

    def get(self, name: str) -> str:
        if name not in self.seq:
            raise ValueError(f"no germline gene is called {name}")
        return self.seq[name]


def _open(p: Params, gap_open: int) -> Params:
    return Params(p.match, p.mismatch, gap_open, p.gap_extend)


def _pair(query: str, target: str, mode: str, params: Params):
    if not query or not target:
        raise ValueError(f"nothing to align ({mode})")
    (a,) = yield Ask(((query, target),), mode, params)
    return a


def _two_step(query: str, target: str, first: Params, second: Params):
    """Semiglobal, then local of the stretches that it covers."""
    sg = yield from _pair(query, target, "semiglobal", first)
    loc = yield from _pair(query[sg.query_begin : sg.query_end + 1], target[sg.target_begin : sg.target_end + 1], "local", second)
    return sg, loc


def _starts(sg: Alignment, loc: Alignment) -> tuple[int, int]:
    if sg.query_begin < sg.target_begin:
        return sg.query_begin + loc.query_begin, sg.target_begin + loc.target_begin
    return sg.query_begin, sg.target_begin


def _frame(start: int) -> int:
    return (3 - start % 3) % 3 + 1


def _global(query: str, target: str, p: Params):
    if not query or not target:
        return Alignment(query, target, query or "-" * len(target), target or "-" * len(query), 0, len(query) - 1, 0, len(target) - 1, 0)
    return (yield from _pair(query, target, "global", p))


def region(aln: Alignment, gapped: str, start: int, name: str, aa: bool = False, nt_start: int | None = None) -> tuple[int | None, str]:
    """Start column and sequence of an IMGT region of the aligned query; empty if the read begins after it.

    ``start`` is the germline's first base, 1-based.

    In nucleotides a gap run at an end that is no whole codon moves that end by codons, within the alignment.
    """
    first, last = (R.AA_BOUNDS if aa else R.NT_BOUNDS)[name]
    if gapped_from_raw_text(start + 1, gapped) > last:
        return None, ""
    a = aligned_from_ungapped_text(raw_from_gapped_text(first, gapped, start), aln.aligned_target)
    b = aligned_from_ungapped_text(raw_from_gapped_text(last, gapped, start), aln.aligned_target, True)
    if aa and nt_start == 0 and a:
        a = 0
    if a is None or b is None:
        return a, ""
    cut = lambda: aln.aligned_query[a : b + 1]
    if not aa:
        while (len(cut()) - len(cut().rstrip("-"))) % 3 and b + 1 < len(aln.aligned_query):
            b += 3
        while (len(cut()) - len(cut().lstrip("-"))) % 3 and a < b:
            a += 3
    return a, cut().replace("-", "")


def cdr3_parts(out: dict) -> None:
    """V, N1, D, N2 and J of the CDR3, cut to whole codons."""
    cdr3, v, j, d = out["cdr3"], out["v_sequence"], out["j_sequence"], out["d_sequence"] or ""
    seq = out["sequence"]
    start = seq.find(out["fwr3"] or "") + len(out["fwr3"] or "")
    v_part = v[start:] if start < len(v) else ""
    v_part = v_part[: len(v_part) - len(v_part) % 3]
    tail = len(seq) - len(j)  # J starts here
    j_part = seq[max(tail, start) : start + len(cdr3)] if start + len(cdr3) > tail else ""
    j_part = j_part[len(j_part) % 3 :]
    middle = cdr3[len(v_part) : len(cdr3) - len(j_part)]
    at = middle.find(d) if d else -1
    if at >= 0:
        lead = -at % 3
        d_part = d[lead:]
        d_part = d_part[: len(d_part) - len(d_part) % 3]
        n1, n2 = middle[: at + lead], middle[at + lead + len(d_part) :]
    else:
        d_part, n1, n2 = "", middle, ""
    for name, part in (("v", v_part), ("n1", n1), ("d", d_part), ("n2", n2), ("j", j_part)):
        out[f"cdr3_{name}"], out[f"cdr3_{name}_aa"] = part, translate_text(part)


def _segment_mask(out: dict, aa: bool) -> str:
    s = "_aa" if aa else ""
    of = lambda c: out[c + s] or ""
    d, n2 = (of("cdr3_d"), of("cdr3_n2")) if out["d_call"] else (None, None)
    return R.segment_mask_text("".join(of(r) for r in R.REGIONS[:5]), len(of("v_sequence")), of("cdr3_v"), of("cdr3_n1"), d, n2, of("cdr3_j"), len(out["j_sequence"]), of("fwr4"), of("cdr3") if aa else None)


def annotate_one(row: dict, germ: Germlines, p: AnnotateParams):
    """Generator of Asks; returns the output row."""
    out: dict = dict.fromkeys(OUTPUT_COLUMNS)
    sc = p.scoring
    out |= {k: row.get(k) for k in ("sequence_id", "sequence_input", "quality", "rev_comp", "v_support", "d_support", "j_support", "c_support")}
    raw = (row["sequence_input"] or "").upper()
    if p.umis:
        out["umi"] = find_umis(raw, p.umis)
    seq = revcomp_text(raw) if row["rev_comp"] else raw
    v_name, d_name, j_name, c_name = (row[f"{s}_call"] for s in "vdjc")
    out |= {"productive": True, "stop_codon": False, "v_frameshift": False, "complete_vdj": False, "sequence_oriented": seq, "germline_database": p.germline_database}
    locus = out["locus"] = v_name[:3].upper()
    out["species"] = v_name.split("__")[-1] if "__" in v_name else p.germline_database
    for s, name in zip("vdjc", (v_name, d_name, j_name, c_name)):
        if name:
            out[f"{s}_call"] = name.split("__")[0]
            out[f"{s}_gene"] = out[f"{s}_call"].split("*")[0]

    # V
    v_sg, v_loc = yield from _two_step(seq, germ.get(v_name), sc, sc)
    vs, vg = _starts(v_sg, v_loc)
    ve, vge = v_sg.query_begin + v_loc.query_end + 1, v_sg.target_begin + v_loc.target_end + 1
    frame = _frame(vg)
    v_seq, v_germ = seq[vs:ve], germ.get(v_name)[vg:vge]
    out |= {"v_score": float(v_loc.score), "v_sequence_start": vs, "v_sequence_end": ve, "v_germline_start": vg, "v_germline_end": vge, "frame": frame, "v_frame": frame, "v_sequence": v_seq, "v_germline": v_germ}
    out["v_sequence_aa"], out["v_germline_aa"] = translate_text(v_seq, frame), translate_text(v_germ, frame)
    v_all = yield from _global(v_seq, v_germ, sc)
    v_aa = yield from _global(out["v_sequence_aa"], out["v_germline_aa"], sc)
    gapped = germ.gapped[v_name]
    gapped_aa = translate_text(gapped, dots=True)
    out["v_germline_gapped"] = gapped
    out["v_sequence_gapped"] = gapped_sequence_text(v_all.aligned_query, v_all.aligned_target, gapped, vg)
    ins = indels_text(v_all.aligned_query, v_all.aligned_target, gapped, vg, "insertion") if "-" in v_loc.aligned_target + v_all.aligned_target else []
    dels = indels_text(v_loc.aligned_query, v_loc.aligned_target, gapped, vg, "deletion") if "-" in v_loc.aligned_query else []
    out["v_insertions"], out["v_deletions"] = "|".join(ins), "|".join(dels)
    size = lambda xs: sum(int(x.split(":")[1].split(">")[0]) for x in xs)
    out["v_frameshift"] = (size(ins) - size(dels)) % 3 != 0

    # J
    rest = seq[ve:]
    j_germ_full = germ.get(j_name)
    j_sg, j_loc = yield from _two_step(rest, j_germ_full, _open(sc, p.j_semiglobal_open), _open(sc, p.j_local_open))
    js, jg = ve + j_sg.query_begin + j_loc.query_begin, j_sg.target_begin + j_loc.target_begin
    covered_q, covered_t = j_sg.query_end - j_sg.query_begin, j_sg.target_end - j_sg.target_begin
    left_t, left_q = covered_t - j_loc.target_end, covered_q - j_loc.query_end
    if left_t >= 1 and left_q >= left_t:
        je = ve + j_sg.query_end + 1
        jge = (jg if p.compat else 0) + j_sg.target_end + 1
    else:
        je, jge = ve + j_sg.query_begin + j_loc.query_end + 1, j_sg.target_begin + j_loc.target_end + 1
    j_seq, j_germ = seq[js:je], j_germ_full[jg:jge]
    out |= {"j_score": float(j_loc.score), "j_sequence_start": js, "j_sequence_end": je, "j_germline_start": jg, "j_germline_end": jge, "j_sequence": j_seq, "j_germline": j_germ}

    # D
    between, d_loc = seq[ve:js], None
    if between and d_name:
        d_loc = yield from _pair(between, germ.get(d_name), "local", sc)
    elif len(between) >= 5 and locus in p.d_loci:
        names = [a for a in germ.of["d"] if "IGHD" in a] or []
        if names:
            found = yield Ask(tuple((between, germ.get(a)) for a in names), "local", sc)
            best = max(range(len(names)), key=lambda i: (found[i].score, -i))
            if found[best].score > 0:
                d_loc, d_name = found[best], names[best]
                out["d_call"], out["d_gene"] = d_name, d_name.split("*")[0]
    else:
        out["d_call"] = out["d_gene"] = None
    d_seq = ""
    if d_loc is not None and d_loc.score > 0:
        ds, de = ve + d_loc.query_begin, ve + d_loc.query_end + 1
        dg = d_loc.target_begin
        dge = dg + ((d_loc.query_end - d_loc.query_begin) if p.compat else (d_loc.target_end - d_loc.target_begin)) + 1
        d_seq = seq[ds:de]
        out |= {"d_score": float(d_loc.score), "d_sequence": d_seq, "d_germline": germ.get(d_name)[dg:dge], "d_frame": _frame(dg)}
        out["np1"], out["np2"] = seq[ve:ds], seq[de:js]
        out["np2_length"] = len(out["np2"])
    else:
        out["d_call"] = out["d_gene"] = None
        out["np1"] = between
    out["np1_length"] = len(out["np1"])

    # assembly
    middle = out["np1"] + d_seq + (out["np2"] or "")
    middle_germ = out["np1"] + (out["d_germline"] or "") + (out["np2"] or "")
    out["sequence"], out["germline"] = v_seq + middle + j_seq, v_germ + middle_germ + j_germ
    out["sequence_gapped"], out["germline_gapped"] = out["v_sequence_gapped"] + middle + j_seq, gapped + middle_germ + j_germ
    out["sequence_aa"], out["germline_aa"] = translate_text(out["sequence"], frame), translate_text(out["germline"], frame)

    # C
    if c_name and seq[je:]:
        yield from _constant(out, seq, je, germ, c_name, frame, p)
    full = yield from _global(out["sequence"], out["germline"], sc)
    full_aa = yield from _global(out["sequence_aa"], out["germline_aa"], sc)
    out["sequence_alignment"], out["germline_alignment"] = full.aligned_query, full.aligned_target
    out["sequence_alignment_aa"], out["germline_alignment_aa"] = full_aa.aligned_query, full_aa.aligned_target
    out["complete_vdj"] = vg == 0 and jge == len(j_germ_full)

    # junction: FR3 with the conserved C, FR4 with the conserved W or F, each first aligned to its aligned germline
    near = _open(sc, p.realign_open)
    fr3 = yield from _pair(gapped[FR3].replace(".", ""), v_sg.aligned_target, "semiglobal", near)
    fr3 = yield from _pair(v_sg.aligned_query, fr3.aligned_query.strip("-"), "semiglobal", sc)
    start = len(v_sg.aligned_query[: fr3.query_end].replace("-", "")) - 2
    fr4 = yield from _pair(j_germ_full[-(FR4_HEAVY if locus in HEAVY else FR4_LIGHT) :], j_sg.aligned_target, "semiglobal", near)
    fr4 = yield from _pair(seq[max(0, start) : je], fr4.aligned_query.strip("-"), "semiglobal", sc)
    end = fr4.query_begin + start + 3
    junction = seq[max(0, start) : end]
    out["junction"], out["junction_aa"] = junction, translate_text(junction)
    out["cdr3"], out["cdr3_aa"] = junction[3:-3], out["junction_aa"][1:-1]
    out["cdr3_length"] = len(out["cdr3_aa"])

    # mutations and identity
    muts = mutations_text(v_all.aligned_query, v_all.aligned_target, gapped, vg)
    muts_aa = mutations_text(v_aa.aligned_query, v_aa.aligned_target, gapped_aa, vg // 3)
    out |= {"v_mutations": "|".join(muts), "v_mutation_count": len(muts), "v_mutations_aa": "|".join(muts_aa), "v_mutation_count_aa": len(muts_aa)}
    out["v_identity"] = 1 - len(muts) / len(v_germ)
    out["v_identity_aa"] = 1 - len(muts_aa) / len(out["v_germline_aa"]) if out["v_germline_aa"] else None

    # regions
    for name in R.REGIONS[:5]:
        at, out[name] = region(v_all, gapped, vg + 1, name)
        _, out[f"{name}_aa"] = region(v_aa, gapped_aa, vg // 3 + 1, name, True, at)
    out["fwr4"] = fr4.aligned_query[fr4.query_begin : fr4.query_end + 1]
    out["fwr4_aa"] = translate_text(out["fwr4"])
    cdr3_parts(out)

    # productivity
    out["stop_codon"] = "*" in out["sequence_aa"]
    issues = R.productivity_text(out["sequence"], out["sequence_aa"], out["v_call"], out["j_call"], out["junction_aa"], locus, out["v_frameshift"], p.tryptophan_loci)
    out["productive"], out["productivity_issues"] = not issues, "|".join(issues)

    # masks
    for s, q, g in (("", out["sequence_alignment"], out["germline_alignment"]), ("_aa", out["sequence_alignment_aa"], out["germline_alignment_aa"])):
        out["cdr_mask" + s] = R.cdr_mask_text(*(out[r + s] for r in R.REGIONS))
        out["gene_segment_mask" + s] = _segment_mask(out, bool(s))
        out["nongermline_mask" + s] = R.nongermline_text(q, g, out["gene_segment_mask" + s])
    return out


def _constant(out: dict, seq: str, je: int, germ: Germlines, name: str, v_frame: int, p: AnnotateParams):
    sc, whole = p.scoring, germ.get(name)
    sg, loc = yield from _two_step(seq[je:], whole, sc, sc)
    first, cg = _starts(sg, loc)
    cs = je + first
    ce = (cs if p.compat else je) + sg.query_begin + loc.query_end + 1
    cge = sg.target_begin + loc.target_end + 1
    frame = _frame(cg)
    c_seq, c_germ = seq[cs:ce], whole[cg:cge]
    out |= {"c_score": float(loc.score), "c_sequence_start": cs, "c_sequence_end": ce, "c_germline_start": cg, "c_germline_end": cge, "c_frame": frame, "c_sequence": c_seq, "c_germline": c_germ}
    out["c_sequence_aa"], out["c_germline_aa"] = translate_text(c_seq, frame), translate_text(c_germ, frame)
    nt = yield from _global(c_seq, c_germ, sc)
    aa = yield from _global(out["c_sequence_aa"], out["c_germline_aa"], sc)
    gapped = germ.gapped[name]
    out["c_germline_gapped"], out["c_sequence_gapped"] = gapped, gapped_sequence_text(nt.aligned_query, nt.aligned_target, gapped, cg)
    out["c_germline_gapped_aa"] = translate_text(gapped, dots=True)
    out["c_sequence_gapped_aa"] = translate_text(out["c_sequence_gapped"], v_frame if p.compat else frame, True)
    muts = mutations_text(nt.aligned_query, nt.aligned_target, whole, cg)
    muts_aa = mutations_text(aa.aligned_query, aa.aligned_target, translate_text(whole), cg // 3)
    out |= {"c_mutations": "|".join(muts), "c_mutation_count": len(muts), "c_mutations_aa": "|".join(muts_aa), "c_mutation_count_aa": len(muts_aa)}
    out["c_identity"] = 1 - len(muts) / len(c_germ) if c_germ else None
    out["c_identity_aa"] = 1 - len(muts_aa) / len(out["c_germline_aa"]) if out["c_germline_aa"] else None
    out["c_insertions"] = "|".join(indels_text(nt.aligned_query, nt.aligned_target, whole, cg, "insertion"))
    out["c_deletions"] = "|".join(indels_text(nt.aligned_query, nt.aligned_target, whole, cg, "deletion"))
    for a, b in (("sequence", c_seq), ("germline", c_germ)):
        out[f"{a}_vdjc"] = out[a] + b
        out[f"{a}_vdjc_gapped"] = out[f"{a}_gapped"] + b
        out[f"{a}_vdjc_aa"] = translate_text(out[f"{a}_vdjc"], v_frame)


def annotate_rows(rows: list[dict], germ: Germlines, p: AnnotateParams) -> list[dict]:
    """Output rows with an ``error``, in order."""
    out: list[dict] = [{}] * len(rows)
    live = {}
    for i, row in enumerate(rows):
        live[i] = (annotate_one(row, germ, p), None)
    while live:
        asked: dict[int, Ask] = {}
        for i, (gen, answer) in list(live.items()):
            try:
                asked[i] = gen.send(answer)
            except StopIteration as end:
                out[i] = end.value | {"error": None}
                del live[i]
            except Exception as e:  # a read's failure is its result
                out[i] = dict.fromkeys(OUTPUT_COLUMNS) | {k: rows[i].get(k) for k in ("sequence_id", "sequence_input", "quality", "v_call", "d_call", "j_call", "c_call")} | {"error": f"{type(e).__name__}: {e}"}
                del live[i]
        groups: dict[tuple[str, Params], list[tuple[int, tuple[str, str]]]] = {}
        for i, ask in asked.items():
            groups.setdefault((ask.mode, ask.params), []).extend((i, pair) for pair in ask.pairs)
        answers: dict[int, list[Alignment]] = {i: [] for i in asked}
        for (mode, params), some in groups.items():
            for (i, _), a in zip(some, align([pair for _, pair in some], mode, params)):
                answers[i].append(a)
        for i in asked:
            live[i] = (live[i][0], answers[i])
    return out


def annotate(assigned: DataFrame, germline: DataFrame, params: AnnotateParams | None = None) -> DataFrame:
    """The output columns and ``error`` of every assigned read, and its ``sample`` if it has one.

    The germline table (segment, allele, seq, gapped) is collected: it is a
    reference of a few thousand alleles, and larger ones are refused.
    """
    p = params or AnnotateParams()
    rows = germline.select("segment", "allele", "seq", "gapped").limit(200_001).collect()
    if len(rows) > 200_000:
        raise ValueError("a germline database has at most 200,000 alleles")
    shared = assigned.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])
    more = [c for c in assigned.columns if c == "sample"]
    kinds = T.StructType([*FAILED.fields, *(T.StructField(c, T.StringType()) for c in more)])
    schema = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        germ = Germlines(shared.value)
        for b in batches:
            for first in range(0, b.num_rows, 512):
                rows = b.slice(first, 512).to_pylist()
                yield pa.RecordBatch.from_pylist([out | {c: row[c] for c in more} for row, out in zip(rows, annotate_rows(rows, germ, p))], schema=schema)

    return assigned.mapInArrow(run, kinds)


def succeeded(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull()).drop("error")


def failed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNotNull())
