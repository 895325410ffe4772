"""Queries that hold assignment, annotation, UMIs, merging and alignment against SQL.

Reads are recombined from the synthetic germline by one recipe that both
engines evaluate: layers of expressions over a key.  As their making is known,
SQL states what the assigner and the annotation kernel must find in them:
V genes with up to four substitutions, inserted bases, D, J and C genes, both
strands.  Alignment scores come from a recursive dynamic programme in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneweave.functions import regions as R
from cloneweave.functions import sequence as S
from cloneweave.operators import annotate as A
from cloneweave.operators import assign as G
from cloneweave.operators import merge as M
from cloneweave.operators.align import Params, align
from cloneweave.operators.umi import parse_umis
from cloneweave.plans import synthetic as Y
from cloneweave.plans.queries import HEX, GERM, PLAIN, READ, TRANSLATE_SQL, digits, query, table
from cloneweave.sources.sinks import usage

GENES = Y.genes()


def _names(segment: str, start: str, column: int) -> list[str]:
    return [g[column] for g in GENES if g[0] == segment and g[1].startswith(start)]


def _pick(spark: bool, values: list[str], index: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({items}), {index})" if spark else f"([{items}])[{index}]"


def _changed(seq: str, at: str) -> str:
    """Another base at a place (1-based)."""
    return f"substr({seq}, 1, {at} - 1) || translate(substr({seq}, {at}, 1), 'ACGT', 'CGTA') || substr({seq}, {at} + 1)"


SPOT = "(60 + 40 * {i} + k % 37)"


def _layers(spark: bool) -> list[dict[str, str]]:
    """The recipe: each layer's expressions see the columns of those before."""
    gene = lambda seg, column, index: f"CASE WHEN heavy THEN {_pick(spark, _names(seg, 'IGH', column), index)} ELSE {_pick(spark, _names(seg, 'IGK', column), index)} END"
    either = lambda column: f"CASE WHEN k % 4 >= 2 THEN '' WHEN heavy THEN {_pick(spark, [g[column] for g in GENES if g[1].startswith(('IGHM', 'IGHG1'))], '1 + k % 2')} ELSE '{_names('c', 'IGK', column)[0]}' END"
    d = lambda column: f"CASE WHEN heavy THEN {_pick(spark, _names('d', 'IGH', column), '1 + (k * 11) % 5')} ELSE '' END"
    return [
        {"k": "CAST(s_suppkey AS INT)"},
        {"heavy": "k % 3 <> 0", "hx": f"translate(md5('' || k) || md5('' || k || 'x'), '{HEX}', '{PLAIN}')", "muts": "k % 5"},
        {f"{s}_{c}": gene(s, n, i) for s, i in (("v", "1 + (k * 7) % 12"), ("j", "1 + (k * 5) % 4")) for c, n in (("name", 1), ("seq", 2), ("gap", 3))}
        | {"d_name": d(1), "d_seq": d(2), "c_name": either(1), "c_seq": either(2), "np1": "substr(hx, 1, k % 9)", "np2": "CASE WHEN heavy THEN substr(hx, 20, (k * 3) % 9) ELSE '' END"},
        *({f"m{i + 1}": f"CASE WHEN muts > {i} THEN {_changed('v_seq' if not i else f'm{i}', SPOT.format(i=i))} ELSE {'v_seq' if not i else f'm{i}'} END"} for i in range(4)),
        {"vdj": "m4 || np1 || d_seq || np2 || j_seq"},
        {"body": "vdj || c_seq"},
        {"read": "CASE WHEN k % 2 = 1 THEN reverse(translate(body, 'ACGT', 'TGCA')) ELSE body END"},
    ]


def _duck(layers: list[dict[str, str]], source: str = "supplier") -> str:
    for layer in layers:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {source})"
    return source


RECIPE = _duck(_layers(False))
_aa = lambda s, f=1: TRANSLATE_SQL.format(f=f, amino=S.AMINO).replace("length(s)", f"length({s})").replace("substr(s,", f"substr({s},")
_raw = lambda n: f"length(replace(substr(v_gap, 1, {n}), '.', ''))"
_before = {r: f"substr(m4, {_raw(a - 1)} + 1, {_raw(b)} - {_raw(a - 1)})" for r, (a, b) in list(R.NT_BOUNDS.items())[:5]}
_null = lambda c: f"nullif({c}, '')"
# what annotation must find, layer by layer
TRUTH = _duck(
    [
        {"germ": "v_seq || np1 || d_seq || np2 || j_seq", "lead": "length(j_seq) - CASE WHEN heavy THEN 34 ELSE 31 END", "rest": "length(np1 || d_seq || np2)", "vl": "length(m4)"},
        {"junction": "substr(vdj, vl - 7, 8 + rest + lead + 3)", "fwr4": "substr(j_seq, lead + 1)", "ix": "list_filter(range(1, length(v_gap) + 1), lambda i: substr(v_gap, i, 1) <> '.')"} | _before,
        {"cdr3": "substr(junction, 4, length(junction) - 6)", "junction_aa": _aa("junction"), "vdj_aa": _aa("vdj"), "v_aa": _aa("m4"), "vg_aa": _aa("v_seq")},
        {"cdr3_aa": "substr(junction_aa, 2, length(junction_aa) - 2)", "cdr3_v": "substr(cdr3, 1, 3)", "cdr3_j": "right(cdr3, lead - lead % 3)"},
        {"middle": "substr(cdr3, 4, length(cdr3) - 3 - length(cdr3_j))", "d_at": "2 + length(np1)"},
        {"off": "(3 - d_at % 3) % 3"},
        {"cdr3_d": "CASE WHEN heavy THEN substr(d_seq, off + 1, length(d_seq) - off - (length(d_seq) - off) % 3) ELSE '' END"},
        {"cdr3_n1": "CASE WHEN heavy THEN substr(middle, 1, d_at + off) ELSE middle END", "cdr3_n2": "CASE WHEN heavy THEN substr(middle, d_at + off + length(cdr3_d) + 1) ELSE '' END"},
        {"segments": "repeat('V', vl - 5 + 3) || repeat('N', length(cdr3_n1)) || repeat('D', length(cdr3_d)) || repeat('N', length(cdr3_n2)) || repeat('J', length(cdr3_j)) || repeat('J', length(fwr4))"},
    ],
    RECIPE,
)


def reads(spark, sf_dir, layers=None) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    for layer in layers or _layers(True):
        rows = rows.selectExpr("*", *(f"{e} AS {n}" for n, e in layer.items()))
    return G.spread(rows.select(F.concat(F.lit(""), "k").alias("sequence_id"), F.col("read").alias("sequence_input"), F.lit("").alias("quality")))


def annotated(spark, sf_dir, layers=None) -> DataFrame:
    germ = Y.germline(spark)
    return A.succeeded(A.annotate(G.assigned(G.assign(reads(spark, sf_dir, layers), germ)), germ, A.AnnotateParams(germline_database="synthetic")))


CALLED = {f"{s}_call": _null(f"{s}_name") for s in "vdjc"}


@query("truth_assign", f"SELECT '' || k AS sequence_id, k % 2 = 1 AS rev_comp, {', '.join(f'{e} AS {n}' for n, e in CALLED.items())} FROM {TRUTH}")
def truth_assign(spark, sf_dir):
    """Calls of all four segments and the strand: V, J, D and C searches, slices, best hits and their joins."""
    return G.assign(reads(spark, sf_dir), Y.germline(spark)).select("sequence_id", "rev_comp", *CALLED)


def _register(name: str, about: str, columns: dict[str, str], truth: str = TRUTH, layers=None) -> None:
    def run(spark, sf_dir):
        return annotated(spark, sf_dir, layers).select("sequence_id", *columns)

    run.__name__, run.__doc__ = name, about
    query(name, f"SELECT '' || k AS sequence_id, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {truth}")(run)


_big = lambda e: f"CAST({e} AS BIGINT)"
_dbl = lambda e: f"CAST({e} AS DOUBLE)"
_each = lambda seg: f"split_part({seg}_name, '__', 1)"
_gene = lambda seg: f"split_part({_each(seg)}, '*', 1)"
_if_c = lambda e: f"CASE WHEN c_seq <> '' THEN {e} END"

_register("truth_genes", "Names, genes, locus, species, strand and completeness.", {f"{s}_call": _null(_each(s)) for s in "vdjc"} | {f"{s}_gene": _null(_gene(s)) for s in "vdjc"} | {"locus": "substr(v_name, 1, 3)", "species": "'homo_sapiens'", "rev_comp": "k % 2 = 1", "sequence_oriented": "body", "complete_vdj": "true"})
_register(
    "truth_segments",
    "Realigned V, D, J and C: sequences, germlines, coordinates, frames, scores; the bases between.",
    {"v_sequence": "m4", "v_germline": "v_seq", "v_sequence_start": _big("0"), "v_sequence_end": _big("vl"), "v_germline_start": _big("0"), "v_germline_end": _big("vl"), "frame": _big("1"), "v_score": _dbl("3 * vl - 5 * muts")}
    | {"d_sequence": _null("d_seq"), "d_germline": _null("d_seq"), "d_score": f"CASE WHEN heavy THEN {_dbl('3 * length(d_seq)')} END", "d_frame": f"CASE WHEN heavy THEN {_big('1')} END"}
    | {"j_sequence": "j_seq", "j_germline": "j_seq", "j_sequence_start": _big("vl + rest"), "j_sequence_end": _big("length(vdj)"), "j_germline_start": _big("0"), "j_germline_end": _big("length(j_seq)"), "j_score": _dbl("3 * length(j_seq)")}
    | {"np1": "np1", "np2": "CASE WHEN heavy THEN np2 END", "np1_length": _big("length(np1)"), "np2_length": f"CASE WHEN heavy THEN {_big('length(np2)')} END"},
)
_register(
    "truth_constant",
    "The C gene: sequence, germline, coordinates, identity, and the sequence with it.",
    {"c_sequence": _null("c_seq"), "c_germline": _null("c_seq"), "c_sequence_start": _if_c(_big("length(vdj)")), "c_sequence_end": _if_c(_big("length(body)")), "c_germline_start": _if_c(_big("0")), "c_germline_end": _if_c(_big("length(c_seq)")), "c_score": _if_c(_dbl("3 * length(c_seq)"))}
    | {"c_mutation_count": _if_c(_big("0")), "c_identity": _if_c("CAST(1 AS DOUBLE)"), "c_sequence_aa": _if_c(_aa("c_seq")), "sequence_vdjc": _if_c("body"), "sequence_vdjc_aa": _if_c(_aa("body"))},
)
_GAPPED = "array_to_string(list_transform(range(1, length(v_gap) + 1), lambda i: CASE WHEN substr(v_gap, i, 1) = '.' THEN '.' ELSE substr(m4, length(replace(substr(v_gap, 1, i), '.', '')), 1) END), '')"
_register(
    "truth_sequences",
    "Assembled sequences, their translations, IMGT gaps and global alignments.",
    {"sequence": "vdj", "germline": "germ", "sequence_aa": "vdj_aa", "germline_aa": _aa("germ"), "v_sequence_aa": "v_aa", "v_germline_aa": "vg_aa", "v_germline_gapped": "v_gap", "v_sequence_gapped": _GAPPED, "sequence_gapped": f"{_GAPPED} || substr(vdj, vl + 1)", "germline_gapped": "v_gap || substr(vdj, vl + 1)"}
    | {"sequence_alignment": "vdj", "germline_alignment": "germ", "sequence_alignment_aa": "vdj_aa", "germline_alignment_aa": _aa("germ")},
)
_register("truth_junction", "Junction, CDR3 and its length, FWR4.", {"junction": "junction", "junction_aa": "junction_aa", "cdr3": "cdr3", "cdr3_aa": "cdr3_aa", "cdr3_length": _big("length(cdr3_aa)"), "fwr4": "fwr4", "fwr4_aa": _aa("fwr4")})
_register("truth_regions", "FWR1 to FWR3, in bases and amino acids.", {r: r for r in _before} | {f"{r}_aa": _aa(r) for r in _before})
_register("truth_cdr3_parts", "What V, N1, D, N2 and J give to the CDR3.", {f"cdr3_{x}": f"cdr3_{x}" for x in ("v", "n1", "d", "n2", "j")} | {f"cdr3_{x}_aa": _aa(f"cdr3_{x}") for x in ("v", "n1", "d", "n2", "j")})
_AT = "list_transform(range(0, muts), lambda i: 60 + 40 * i + k % 37)"
_AAS = "list_filter(range(1, length(v_aa) + 1), lambda i: substr(v_aa, i, 1) <> substr(vg_aa, i, 1))"
_register(
    "truth_mutations",
    "Substitutions of V in IMGT numbering, in bases and amino acids, and identities.",
    {"v_mutations": f"array_to_string(list_transform({_AT}, lambda p: concat(ix[p], ':', substr(v_seq, p, 1), '>', substr(m4, p, 1))), '|')", "v_mutation_count": _big("muts"), "v_identity": "1 - CAST(muts AS DOUBLE) / length(v_seq)"}
    | {"v_mutations_aa": f"array_to_string(list_transform({_AAS}, lambda i: concat((ix[3 * i - 2] - 1) // 3 + 1, ':', substr(vg_aa, i, 1), '>', substr(v_aa, i, 1))), '|')", "v_mutation_count_aa": _big(f"len({_AAS})"), "v_identity_aa": f"1 - CAST(len({_AAS}) AS DOUBLE) / length(vg_aa)"}
    | {"v_insertions": "''", "v_deletions": "''", "v_frameshift": "false"},
)
_MASK = " || ".join(f"repeat('{R.DIGITS.get(r, '0')}', length({{{r}}}))" for r in R.REGIONS)
_register(
    "truth_masks",
    "CDR, gene segment and non-germline masks.",
    {"cdr_mask": _MASK.format(**{r: r for r in R.REGIONS}), "cdr_mask_aa": _MASK.format(**{r: "cdr3_aa" if r == "cdr3" else _aa(r) for r in R.REGIONS}), "gene_segment_mask": "segments"}
    | {"nongermline_mask": "array_to_string(list_transform(range(1, length(vdj) + 1), lambda i: CASE WHEN substr(segments, i, 1) = 'N' OR substr(vdj, i, 1) <> substr(germ, i, 1) THEN '1' ELSE '0' END), '')"},
)
_ISSUES = f"""list_filter([CASE WHEN contains(vdj_aa, '*') THEN '{R.STOP}' END, CASE WHEN substr(junction_aa, 1, 1) <> 'C' THEN '{R.NO_START}' END,
  CASE WHEN heavy AND right(junction_aa, 1) <> 'W' THEN '{R.NO_END.format('W')}' WHEN NOT heavy AND right(junction_aa, 1) <> 'F' THEN '{R.NO_END.format('F')}' END], lambda x: x IS NOT NULL)"""
_register("truth_productivity", "Stop codons, the junction's ends, and the verdict.", {"productive": f"len({_ISSUES}) = 0", "stop_codon": "contains(vdj_aa, '*')", "productivity_issues": f"array_to_string({_ISSUES}, '|')"})


@query("gene_usage", f"SELECT {_gene('v')} AS v_gene, CAST(count(*) AS BIGINT) AS n FROM {TRUTH} WHERE len({_ISSUES}) = 0 GROUP BY 1")
def gene_usage(spark, sf_dir):
    """Productive reads of each V gene."""
    return usage(annotated(spark, sf_dir))


# --- insertions and deletions of V ---------------------------------------

_PLACE = "100 + k % 50"


def _indels(spark: bool) -> list[dict[str, str]]:
    """One to three equal bases unlike their neighbours put in, or one base unlike its neighbours left out, in turn."""
    layers = _layers(spark)[:3]
    a, b = "substr(v_seq, place, 1)", "substr(v_seq, place + 1, 1)"
    lone = " ".join(f"WHEN substr(v_seq, place + {i}, 1) <> substr(v_seq, place + {i + 1}, 1) AND substr(v_seq, place + {i + 1}, 1) <> substr(v_seq, place + {i + 2}, 1) THEN place + {i + 1}" for i in range(8))
    return [
        *layers,
        {"place": _PLACE},
        {"extra": f"repeat(substr(replace(replace('ACGT', {a}, ''), {b}, ''), 1, 1), 1 + k % 3)", "gone": f"CASE {lone} ELSE place + 9 END"},
        {"vdj": "CASE WHEN k % 2 = 0 THEN substr(v_seq, 1, place) || extra || substr(v_seq, place + 1) ELSE substr(v_seq, 1, gone - 1) || substr(v_seq, gone + 1) END || np1 || d_seq || np2 || j_seq"},
        {"read": "vdj"},
    ]


_register(
    "truth_indels",
    "Insertions and deletions of V in IMGT numbering, and frameshifts.",
    {
        "v_insertions": "CASE WHEN k % 2 = 0 THEN concat(ix[place], ':', length(extra), '>', extra, CASE WHEN length(extra) = 3 THEN '' ELSE '!' END) ELSE '' END",
        "v_deletions": "CASE WHEN k % 2 = 1 THEN concat(ix[gone], ':1>', substr(v_seq, gone, 1), '!') ELSE '' END",
        "v_frameshift": "k % 2 = 1 OR length(extra) < 3",
    },
    _duck([*_indels(False), {"ix": "list_filter(range(1, length(v_gap) + 1), lambda i: substr(v_gap, i, 1) <> '.')"}]),
    _indels(True),
)


# --- alignment scores ----------------------------------------------------

SCORES = Params(gap_open=-8)


def score_sql(mode: str, p: Params = SCORES) -> str:
    """Best affine score of each pair by the textbook recurrence, a row of the matrix a step."""
    g, x, low = p.gap_open, p.gap_extend, -100000
    first = f"list_transform(range(0, m + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE {g} + {x} * (j - 1) END)" if mode == "global" else "list_transform(range(0, m + 1), lambda j: 0)"
    edge = f"{g} + {x} * i" if mode == "global" else "0"
    floor_ = "0" if mode == "local" else str(low)
    best = {"local": "greatest(best, list_max(h2))", "semiglobal": "greatest(best, h2[m + 1], CASE WHEN i + 1 = n THEN list_max(h2) ELSE best END)", "global": "h2[m + 1]"}[mode]
    return f"""WITH RECURSIVE p AS (SELECT s_suppkey, replace(q, '-', '') AS q, replace(g, '-', '') AS g, CAST(length(replace(q, '-', '')) AS INT) AS n, CAST(length(replace(g, '-', '')) AS INT) AS m FROM (
  SELECT s_suppkey, translate(md5(CAST(s_suppkey AS VARCHAR)) || md5(CAST(s_suppkey AS VARCHAR) || 'x'), '{HEX}', '{READ}') AS q, translate(md5(CAST(s_suppkey AS VARCHAR)) || md5(CAST(s_suppkey AS VARCHAR) || 'x'), '{HEX}', '{GERM}') AS g FROM supplier)),
dp AS (SELECT s_suppkey, 0 AS i, {first} AS h, list_transform(range(0, m + 1), lambda j: {low}) AS e, CAST(0 AS BIGINT) AS best FROM p
  UNION ALL SELECT s_suppkey, i + 1, h2, e2, {best} FROM (
    SELECT *, list_transform(range(0, m + 1), lambda j: greatest({floor_}, base[j + 1], CASE WHEN j = 0 THEN {low} ELSE list_max(list_transform(range(0, j), lambda c: base[c + 1] - {x} * c)) + {g} + {x} * (j - 1) END)) AS h2 FROM (
      SELECT *, list_transform(range(0, m + 1), lambda j: CASE WHEN j = 0 THEN {edge} ELSE greatest(e2[j + 1], h[j] + CASE WHEN substr(q, i + 1, 1) = substr(g, j, 1) THEN {p.match} ELSE {p.mismatch} END) END) AS base FROM (
        SELECT dp.*, q, g, n, m, list_transform(range(0, m + 1), lambda j: greatest(h[j + 1] + {g}, e[j + 1] + {x})) AS e2 FROM dp JOIN p USING (s_suppkey) WHERE i < n))))
SELECT s_suppkey, CAST(best AS INT) AS score, CAST(best AS INT) AS rescored, true AS whole FROM dp JOIN p USING (s_suppkey) WHERE i = n"""


def _rescored(a, mode: str, p: Params) -> int:
    """The score of an alignment's strings; end gaps of a semiglobal one are free."""
    q, t = a.aligned_query, a.aligned_target
    if mode == "semiglobal":
        first = max(len(x) - len(x.lstrip("-")) for x in (q, t))
        last = min(len(x.rstrip("-")) for x in (q, t))
        q, t = q[first:last], t[first:last]
    score, before = 0, ""
    for x, y in zip(q, t):
        gap = "q" if x == "-" else "t" if y == "-" else ""
        score += (p.gap_extend if gap == before else p.gap_open) if gap else p.match if x == y else p.mismatch
        before = gap
    return score


def _aligned(mode: str):
    @query(f"{mode}_score", score_sql(mode))
    def run(spark, sf_dir):
        """Best score, the score of the strings returned, and whether they hold both sequences."""
        import pyarrow as pa

        h = digits(F.col("s_suppkey"))
        bare = lambda to: F.replace(F.translate(h, HEX, to), F.lit("-"), F.lit(""))
        rows = table(spark, sf_dir, "supplier").select("s_suppkey", bare(READ).alias("q"), bare(GERM).alias("g"))

        def each(batches):
            for b in batches:
                pairs = list(zip(b["q"].to_pylist(), b["g"].to_pylist()))
                found = align(pairs, mode, SCORES)
                whole = [x.aligned_query.replace("-", "") == (q[x.query_begin : x.query_end + 1] if mode == "local" else q) and x.aligned_target.replace("-", "") == (g[x.target_begin : x.target_end + 1] if mode == "local" else g) for (q, g), x in zip(pairs, found)]
                yield pa.record_batch([b["s_suppkey"], pa.array([x.score for x in found], pa.int32()), pa.array([_rescored(x, mode, SCORES) for x in found], pa.int32()), pa.array(whole)], ["s_suppkey", "score", "rescored", "whole"])

        return rows.mapInArrow(each, "s_suppkey long, score int, rescored int, whole boolean")


for _mode in ("local", "semiglobal", "global"):
    _aligned(_mode)


# --- UMIs by aligned flanks, merged pairs --------------------------------

FLANK = "TCAGCGGGAAGACATT"
_HEXED = f"translate(md5(CAST({{k}} AS VARCHAR)) || md5(CAST({{k}} AS VARCHAR) || 'x'), '{HEX}', '{PLAIN}')"


def _with(*places: int) -> str:
    swap = str.maketrans("ACGT", "CGTA")
    return "".join(c.translate(swap) if i in places else c for i, c in enumerate(FLANK))


FLANKS = [FLANK, _with(7), _with(4, 8, 11)]  # the last has more mismatches than are allowed


@query("umi_aligned", f"SELECT o_orderkey || '_' || substr(s, 13, 8) AS sequence_id, substr(s, 1, 12) || ([{', '.join(repr(x) for x in FLANKS)}])[1 + o_orderkey % 3] || substr(s, 13, 30) AS sequence_input, substr(s, 13, 8) AS umi FROM (SELECT o_orderkey, {_HEXED.format(k='o_orderkey')} AS s FROM orders) WHERE o_orderkey % 3 < 2")
def umi_aligned(spark, sf_dir):
    """Reads with a flank before the UMI: as it is, with one mismatch, with three."""
    s = F.translate(digits(F.col("o_orderkey")), HEX, PLAIN)
    flank = F.element_at(F.array(*map(F.lit, FLANKS)), (1 + F.col("o_orderkey") % 3).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sequence_id"), F.concat(F.substring(s, 1, 12), flank, F.substring(s, 13, 30)).alias("sequence_input"))
    return parse_umis(rows, f"{FLANK}[UMI]", 8, 1)


@query("merge_overlap", f"SELECT CAST(c_custkey AS VARCHAR) AS sequence_id, {_HEXED.format(k='c_custkey')} AS sequence_input, repeat('I', 64) AS quality FROM customer")
def merge_overlap(spark, sf_dir):
    """Pairs cut from each customer's sequence, merged again."""
    s = F.translate(digits(F.col("c_custkey")), HEX, PLAIN)
    cut = lambda c: table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sequence_id"), c.alias("sequence_input"), F.repeat(F.lit("I"), F.length(c)).alias("quality"))
    return M.merge_reads(cut(F.substring(s, 1, 50)), cut(S.revcomp(F.substring(s, 15, 50))), M.MergeParams(adapters=None))
