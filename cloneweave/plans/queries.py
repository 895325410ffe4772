"""Queries over the driver's tables and their SQL.

The tables hold no nucleotides.  Long ones come from texts (letters to bases),
short ones from the MD5 of a key (hexadecimal digits to bases); both engines
make them alike.  Aligned pairs map some digits to a gap or to another base on
one side only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneweave.functions import positions as P
from cloneweave.functions import regions as R
from cloneweave.functions import sequence as S
from cloneweave.functions import umi as U
from cloneweave.functions import variants as X
from cloneweave.operators import annotate as A
from cloneweave.operators import assign as G
from cloneweave.operators import merge as M
from cloneweave.operators.align import Params, align
from cloneweave.plans import synthetic as Y
from cloneweave.sources import germline as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
HEX, PLAIN = "0123456789abcdef", "ACGTACGTACGTACGT"
GERM, READ = "ACGTACGTACGTAC-G", "ACGTACGTAAG-AC-G".replace("AC-G", "ACTG")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nt(text: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


def digits(key: Column) -> Column:
    k = key.cast("string")
    return F.concat(F.md5(k.cast("binary")), F.md5(F.concat(k, F.lit("x")).cast("binary")))


NT = f"translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"


def hexed(key: str, to: str = PLAIN) -> str:
    return f"translate(md5(CAST({key} AS VARCHAR)) || md5(CAST({key} AS VARCHAR) || 'x'), '{HEX}', '{to}')"


# --- sequences -----------------------------------------------------------

TRANSLATE_SQL = """array_to_string(list_transform(range(0, greatest(0, (length(s) - {f} + 1) // 3)), lambda i:
  substr('{amino}', 1 + 16 * (strpos('TCAG', substr(s, {f} + 3 * i, 1)) - 1) + 4 * (strpos('TCAG', substr(s, {f} + 3 * i + 1, 1)) - 1) + strpos('TCAG', substr(s, {f} + 3 * i + 2, 1)) - 1, 1)), '')"""


@query("revcomp", f"SELECT doc_id, reverse(translate({NT}, '{S.IUPAC}', '{S.COMPLEMENT}')) AS rc FROM documents")
def revcomp(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.revcomp(nt(F.col("text"))).alias("rc"))


def _translated(frame: int):
    sql = f"SELECT item_id, {TRANSLATE_SQL.format(f=frame, amino=S.AMINO)} AS aa FROM (SELECT item_id, {NT} AS s FROM benchmark)"

    @query(f"translate_frame{frame}", sql)
    def run(spark, sf_dir):
        return table(spark, sf_dir, "benchmark").select("item_id", S.translate(nt(F.col("text")), frame).alias("aa"))


for _frame in (1, 2, 3):
    _translated(_frame)


@query("aa_usage", f"SELECT unnest(string_split(aa, '')) AS aa, CAST(count(*) AS BIGINT) AS n FROM (SELECT {TRANSLATE_SQL.format(f=1, amino=S.AMINO)} AS aa FROM (SELECT {NT} AS s FROM documents)) WHERE aa <> '' GROUP BY 1")
def aa_usage(spark, sf_dir):
    """Every amino acid of every text."""
    aa = S.translate(nt(F.col("text")))
    return table(spark, sf_dir, "documents").select(F.explode(F.split(aa, "")).alias("aa")).filter("aa <> ''").groupBy("aa").agg(F.count(F.lit(1)).alias("n"))


CALL = "'IG' || substr('HKL', 1 + CAST(p_partkey % 3 AS INT), 1) || substr('VDJ', 1 + CAST(p_size % 3 AS INT), 1) || p_size || '*0' || (1 + p_partkey % 4) || CASE WHEN p_partkey % 2 = 0 THEN '__' || lower(p_type) ELSE '' END"


def calls(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("IG"), F.substring(F.lit("HKL"), (1 + F.col("p_partkey") % 3).cast("int"), F.lit(1)), F.substring(F.lit("VDJ"), (1 + F.col("p_size") % 3).cast("int"), F.lit(1)), F.col("p_size"), F.lit("*0"), 1 + F.col("p_partkey") % 4, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("__"), F.lower("p_type"))).otherwise(F.lit("")))
    return part.select("p_partkey", name.alias("call"))


@query(
    "call_parse",
    f"""SELECT p_partkey, upper(substr(call, 1, 3)) AS locus, split_part(split_part(call, '__', 1), '*', 1) AS gene,
    split_part(call, '__', 1) AS allele, CASE WHEN contains(call, '__') THEN split_part(call, '__', 2) ELSE 'human' END AS species,
    regexp_matches(call, 'IGH|TRA|TRD') AS heavy FROM (SELECT p_partkey, {CALL} AS call FROM part)""",
)
def call_parse(spark, sf_dir):
    c = F.col("call")
    return calls(spark, sf_dir).select("p_partkey", S.locus(c).alias("locus"), S.gene(S.allele(c)).alias("gene"), S.allele(c).alias("allele"), S.species(c, F.lit("human")).alias("species"), S.heavy_like(c).alias("heavy"))


@query("germline_exact", f"SELECT p_partkey, call AS allele FROM (SELECT p_partkey, {CALL} AS call FROM part) WHERE call = 'IGHV3*02' AND substr(call, 4, 1) = 'V'")
def germline_exact(spark, sf_dir):
    rows = calls(spark, sf_dir).select("p_partkey", F.col("call").alias("allele")).withColumn("segment", D.segment(F.col("allele")))
    return D.matching(rows, "IGHV3*02", exact=True).select("p_partkey", "allele")


@query("germline_substring", f"SELECT p_partkey, call AS allele FROM (SELECT p_partkey, {CALL} AS call FROM part) WHERE contains(call, 'IGHV3') AND substr(call, 4, 1) = 'V'")
def germline_substring(spark, sf_dir):
    rows = calls(spark, sf_dir).select("p_partkey", F.col("call").alias("allele")).withColumn("segment", D.segment(F.col("allele")))
    return D.matching(rows, "IGHV3").select("p_partkey", "allele")


# --- positions and variants ----------------------------------------------

PAIRS = f"""SELECT o_orderkey, {hexed('o_orderkey', READ)} AS q, {hexed('o_orderkey', GERM)} AS g,
  replace(replace({hexed('o_orderkey', GERM)}, '-', ''), 'CG', 'C...G') AS gapped, CAST(o_custkey % 5 AS INT) AS st FROM orders"""
IX = "list_filter(range(1, length(gapped) + 1), lambda i: substr(gapped, i, 1) <> '.')"


def pairs(spark, sf_dir):
    h = digits(F.col("o_orderkey"))
    g = F.translate(h, HEX, GERM)
    gapped = F.replace(F.replace(g, F.lit("-"), F.lit("")), F.lit("CG"), F.lit("C...G"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.translate(h, HEX, READ).alias("q"), g.alias("g"), gapped.alias("gapped"), (F.col("o_custkey") % 5).cast("int").alias("st"))


def cols() -> tuple[Column, Column, Column, Column]:
    return F.col("q"), F.col("g"), F.col("gapped"), F.col("st")


@query("imgt_positions", f"SELECT o_orderkey, CAST(coalesce({IX}[st + 10], length(gapped)) AS INT) AS mid, CAST(coalesce({IX}[st + 60], length(gapped)) AS INT) AS late FROM ({PAIRS})")
def imgt_positions(spark, sf_dir):
    _, _, gap, start = cols()
    return pairs(spark, sf_dir).select("o_orderkey", P.gapped_from_raw(start + 10, gap).cast("int").alias("mid"), P.gapped_from_raw(start + 60, gap).cast("int").alias("late"))


@query("raw_from_gapped", f"SELECT o_orderkey, CAST(greatest(0, length(replace(substr(gapped, 1, 20), '.', '')) - st) AS INT) AS raw FROM ({PAIRS})")
def raw_from_gapped(spark, sf_dir):
    _, _, gap, start = cols()
    return pairs(spark, sf_dir).select("o_orderkey", P.raw_from_gapped(F.lit(20), gap, start).cast("int").alias("raw"))


@query(
    "aligned_positions",
    f"""SELECT o_orderkey, CAST(c - 1 AS INT) AS start_column, CAST(c - 1 + length(regexp_extract(substr(g, c + 1), '^-*')) AS INT) AS end_column,
    CASE WHEN substr(g, 21, 1) <> '-' THEN CAST(length(replace(substr(g, 1, 20), '-', '')) AS INT) END AS ungapped,
    CAST(length(replace(substr(q, 1, c - 1), '-', '')) AS INT) AS in_query
    FROM (SELECT *, list_filter(range(1, length(g) + 1), lambda i: substr(g, i, 1) <> '-')[st + 11] AS c FROM ({PAIRS}))""",
)
def aligned_positions(spark, sf_dir):
    read, germ, _, start = cols()
    return pairs(spark, sf_dir).select(
        "o_orderkey",
        P.aligned_from_ungapped(start + 10, germ).cast("int").alias("start_column"),
        P.aligned_from_ungapped(start + 10, germ, True).cast("int").alias("end_column"),
        P.ungapped_from_aligned(F.lit(20), germ).cast("int").alias("ungapped"),
        P.query_from_reference(start + 10, read, germ).cast("int").alias("in_query"),
    )


SPOTS = "list_filter(range(1, length(g) + 1), lambda i: substr(q, i, 1) <> substr(g, i, 1) AND substr(q, i, 1) <> '-' AND substr(g, i, 1) <> '-')"
MUTATIONS = f"array_to_string(list_transform({SPOTS}, lambda i: concat(coalesce(ix[length(replace(substr(g, 1, i), '-', '')) + st], length(gapped)), ':', substr(g, i, 1), '>', substr(q, i, 1))), '|')"


def _runs(s: str) -> str:
    return f"list_transform(list_filter(range(1, length({s}) + 1), lambda i: substr({s}, i, 1) = '-' AND (i = 1 OR substr({s}, i - 1, 1) <> '-')), lambda i: {{'a': i, 'n': length(regexp_extract(substr({s}, i), '^-+'))}})"


INSERTIONS = f"array_to_string(list_transform({_runs('g')}, lambda r: concat(coalesce(CASE WHEN length(replace(substr(g, 1, r.a - 1), '-', '')) + st > 0 THEN ix[length(replace(substr(g, 1, r.a - 1), '-', '')) + st] END, length(gapped)), ':', r.n, '>', substr(q, r.a, r.n), CASE WHEN r.n % 3 <> 0 THEN '!' ELSE '' END)), '|')"
_AT = "coalesce(ix[length(replace(substr(g, 1, r.a), '-', '')) + st], length(gapped))"
DELETIONS = f"array_to_string(list_transform({_runs('q')}, lambda r: concat({_AT}, CASE WHEN r.n > 1 THEN concat('-', {_AT} + r.n - 1) ELSE '' END, ':', r.n, '>', substr(g, r.a, r.n), CASE WHEN r.n % 3 <> 0 THEN '!' ELSE '' END)), '|')"
WITH_IX = f"(SELECT *, {IX} AS ix FROM ({PAIRS}))"


@query("mutations", f"SELECT o_orderkey, {MUTATIONS} AS mutations, CAST(len({SPOTS}) AS INT) AS mutation_count FROM {WITH_IX}")
def mutations(spark, sf_dir):
    read, germ, gap, start = cols()
    found = pairs(spark, sf_dir).select("o_orderkey", X.mutation_list(read, germ, gap, start).alias("m"))
    return found.select("o_orderkey", F.array_join("m", "|").alias("mutations"), F.size("m").alias("mutation_count"))


@query("insertions", f"SELECT o_orderkey, {INSERTIONS} AS insertions FROM {WITH_IX}")
def insertions(spark, sf_dir):
    read, germ, gap, start = cols()
    return pairs(spark, sf_dir).select("o_orderkey", X.insertions(read, germ, gap, start).alias("insertions"))


@query("deletions", f"SELECT o_orderkey, {DELETIONS} AS deletions FROM {WITH_IX}")
def deletions(spark, sf_dir):
    read, germ, gap, start = cols()
    return pairs(spark, sf_dir).select("o_orderkey", X.deletions(read, germ, gap, start).alias("deletions"))


@query("frameshift", f"SELECT o_orderkey, (length(replace(g, '-', '')) - length(replace(q, '-', ''))) % 3 <> 0 AS frameshift FROM ({PAIRS})")
def frameshift(spark, sf_dir):
    read, germ, gap, start = cols()
    rows = pairs(spark, sf_dir).select("o_orderkey", X.insertions(read, germ, gap, start).alias("i"), X.deletions(read, germ, gap, start).alias("d"))
    return rows.select("o_orderkey", X.frameshift(F.col("i"), F.col("d")).alias("frameshift"))


@query("identity", f"SELECT o_orderkey, round(1 - len({SPOTS}) / length(replace(g, '-', '')), 6) AS identity FROM ({PAIRS})")
def identity(spark, sf_dir):
    read, germ, gap, start = cols()
    n = F.size(X.mutation_list(read, germ, gap, start))
    return pairs(spark, sf_dir).select("o_orderkey", F.round(X.identity(n, F.length(F.replace(germ, F.lit("-"), F.lit("")))), 6).alias("identity"))


# --- regions, masks, productivity ----------------------------------------

GAPPED_V = f"SELECT item_id, replace({NT}, 'CG', 'C...G') AS gapped FROM benchmark"


@query("imgt_regions", "SELECT item_id, " + ", ".join(f"replace(substr(gapped, {a}, {b - a + 1}), '.', '') AS {r}" for r, (a, b) in R.NT_BOUNDS.items()) + f" FROM ({GAPPED_V})")
def imgt_regions(spark, sf_dir):
    _, _, gap, _ = cols()
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.replace(nt(F.col("text")), F.lit("CG"), F.lit("C...G")).alias("gapped"))
    return rows.select("item_id", *[R.region_of_gapped(gap, r).alias(r) for r in R.REGIONS])


PIECES = f"SELECT c_custkey, s, {', '.join(f'substr(s, {1 + 8 * i}, CAST(4 + (c_custkey + {i}) % 5 AS INT)) AS {r}' for i, r in enumerate(R.REGIONS))} FROM (SELECT c_custkey, {hexed('c_custkey')} AS s FROM customer)"


def pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.translate(digits(F.col("c_custkey")), HEX, PLAIN).alias("s"))
    return rows.select("c_custkey", "s", *[F.substring(F.col("s"), F.lit(1 + 8 * i), (4 + (F.col("c_custkey") + i) % 5).cast("int")).alias(r) for i, r in enumerate(R.REGIONS)])


_DIGIT = {"cdr1": "1", "cdr2": "2", "cdr3": "3"}


@query("cdr_mask", f"SELECT c_custkey, {' || '.join(f'''repeat('{_DIGIT.get(r, '0')}', length({r}))''' for r in R.REGIONS)} AS mask FROM ({PIECES})")
def cdr_mask(spark, sf_dir):
    return pieces(spark, sf_dir).select("c_custkey", R.cdr_mask({r: F.col(r) for r in R.REGIONS}).alias("mask"))


@query(
    "segment_mask",
    f"""SELECT c_custkey, repeat('V', least(20 + length(cdr3), h)) || repeat('N', greatest(0, h - 20 - length(cdr3))) || repeat('V', length(cdr1)) || repeat('N', length(cdr2))
    || repeat('D', length(cdr3)) || repeat('N', length(fwr2)) || repeat('J', length(fwr3)) || repeat('J', least(5, length(fwr4))) AS mask
    FROM (SELECT *, length(fwr1 || cdr1 || fwr2 || cdr2 || fwr3) AS h FROM ({PIECES}))""",
)
def segment_mask(spark, sf_dir):
    c = F.col
    before = F.concat("fwr1", "cdr1", "fwr2", "cdr2", "fwr3")
    return pieces(spark, sf_dir).select("c_custkey", R.segment_mask(before, 20 + F.length("cdr3"), c("cdr1"), c("cdr2"), c("cdr3"), c("fwr2"), c("fwr3"), F.lit(5), c("fwr4")).alias("mask"))


@query(
    "nongermline_mask",
    f"""SELECT o_orderkey, array_to_string(list_transform(k, lambda i, n: CASE WHEN substr(seg, CAST(n AS INT), 1) = 'N' OR substr(q, i, 1) <> substr(g, i, 1) THEN '1' ELSE '0' END)[1:length(seg)], '') AS mask
    FROM (SELECT *, list_filter(range(1, length(q) + 1), lambda i: substr(q, i, 1) <> '-') AS k, repeat('V', 30) || repeat('N', st) || repeat('J', 20) AS seg FROM ({PAIRS}))""",
)
def nongermline_mask(spark, sf_dir):
    read, germ, _, start = cols()
    seg = F.concat(F.repeat(F.lit("V"), 30), F.repeat(F.lit("N"), start), F.repeat(F.lit("J"), 20))
    return pairs(spark, sf_dir).select("o_orderkey", R.nongermline_mask(read, germ, seg).alias("mask"))


@query(
    "productivity",
    f"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 7 = 0 THEN 'out-of-frame indel(s)' END, CASE WHEN contains(aa, '*') THEN 'stop codon(s)' END,
      CASE WHEN contains(s, 'N') THEN 'ambiguous nucleotide(s)' END, CASE WHEN substr(call, 1, 3) <> 'IGH' THEN 'V/J locus mismatch (' || call || ' and IGHJ1*01)' END,
      CASE WHEN substr(aa, 2, 1) <> 'C' THEN 'junction does not start with conserved C' END,
      CASE WHEN substr(call, 1, 3) = 'IGH' AND right(aa, 1) <> 'W' THEN 'junction does not end with conserved W'
           WHEN substr(call, 1, 3) <> 'IGH' AND right(aa, 1) <> 'F' THEN 'junction does not end with conserved F' END],
      lambda x: x IS NOT NULL), '|') AS issues FROM (SELECT *, {TRANSLATE_SQL.format(f=1, amino=S.AMINO)} AS aa FROM (SELECT p_partkey, p_size, {CALL} AS call, {hexed('p_partkey')} AS s FROM part))""",
)
def productivity(spark, sf_dir):
    rows = calls(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = rows.withColumn("s", F.translate(digits(F.col("p_partkey")), HEX, PLAIN)).withColumn("aa", S.translate(F.col("s")))
    c = F.col
    issues = R.productivity_issues(c("s"), c("aa"), c("call"), F.lit("IGHJ1*01"), F.substring(c("aa"), F.lit(2), F.length("aa")), S.locus(c("call")), c("p_size") % 7 == 0)
    return rows.select("p_partkey", F.array_join(issues, "|").alias("issues"))


# --- search and joins ----------------------------------------------------

K = 7
KMERS = "(SELECT {id} AS {id}, unnest(range(0, length({seq}) - 6)) AS pos, {seq} FROM {t})"
SEEDS = f"""(SELECT q.c_custkey AS query, q.rev AS strand, g.s_suppkey AS allele, CAST(q.pos - g.pos AS INT) AS diagonal, count(*) AS n
 FROM (SELECT c_custkey, rev, s, unnest(range(0, length(s) - {K - 1})) AS pos FROM (SELECT c_custkey, false AS rev, {hexed('c_custkey')} AS s FROM customer UNION ALL
       SELECT c_custkey, true, reverse(translate({hexed('c_custkey')}, '{S.IUPAC}', '{S.COMPLEMENT}')) FROM customer)) q
 JOIN (SELECT s_suppkey, s, unnest(range(0, length(s) - {K - 1})) AS pos FROM (SELECT s_suppkey, {hexed('s_suppkey')} AS s FROM supplier)) g
 ON substr(q.s, CAST(q.pos + 1 AS INT), {K}) = substr(g.s, CAST(g.pos + 1 AS INT), {K}) GROUP BY ALL)"""


def _seeds(spark, sf_dir):
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), F.translate(digits(F.col("c_custkey")), HEX, PLAIN).alias("seq"))
    g = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("allele"), F.translate(digits(F.col("s_suppkey")), HEX, PLAIN).alias("seq"))
    return q, g, G.SearchParams(k=K)


@query("kmer_seeds", f"SELECT query, strand, allele, diagonal, n FROM {SEEDS}")
def kmer_seeds(spark, sf_dir):
    return G.seeds(*_seeds(spark, sf_dir))


BEST = f"(SELECT query, allele, n, strand FROM (SELECT *, row_number() OVER (PARTITION BY query, allele ORDER BY n DESC, strand, diagonal) AS r FROM {SEEDS}) WHERE r = 1)"


@query("best_diagonal", f"SELECT query, allele, n, strand FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, allele) AS r FROM {BEST}) WHERE r <= 3")
def best_diagonal(spark, sf_dir):
    return G.candidates(*_seeds(spark, sf_dir), 3)


HITS_SQL = f"""(SELECT query, arg_min(allele, (-n, allele)) AS target, max(n) AS nident FROM {BEST} GROUP BY query)"""


def _hits(spark, sf_dir):
    rows = G.candidates(*_seeds(spark, sf_dir)).select("query", F.col("allele").alias("target"), F.lit(0.0).alias("evalue"), F.col("n").alias("nident"))
    return G.best_hit(rows).select("query", "target", "nident")


@query("best_hit", f"SELECT query, target, nident FROM {HITS_SQL}")
def best_hit(spark, sf_dir):
    return _hits(spark, sf_dir)


CHAIN = f"""(SELECT c_custkey, v.target AS v_call, v.nident AS v_nident, o.o_orderkey AS j_call, d.o_orderkey AS d_call FROM customer
 LEFT JOIN {HITS_SQL} v ON c_custkey = v.query
 LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON v.query = o.o_custkey
 LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) d ON v.query = d.o_custkey)"""


def _chain(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    seg = lambda s, c: orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias(f"{c}_query")).agg(F.min("o_orderkey").alias(f"{c}_call"))
    v = _hits(spark, sf_dir).select(F.col("query").alias("v_query"), F.col("target").alias("v_call"), F.col("nident").alias("v_nident"))
    vjd = v.join(seg("F", "j"), F.col("v_query") == F.col("j_query"), "left").join(seg("P", "d"), F.col("v_query") == F.col("d_query"), "left")
    return table(spark, sf_dir, "customer").select("c_custkey").join(vjd, F.col("c_custkey") == F.col("v_query"), "left").select("c_custkey", "v_call", "v_nident", "j_call", "d_call")


@query("assign_left_joins", f"SELECT * FROM {CHAIN}")
def assign_left_joins(spark, sf_dir):
    return _chain(spark, sf_dir)


@query("assigned", f"SELECT * FROM {CHAIN} WHERE v_call IS NOT NULL AND j_call IS NOT NULL")
def assigned(spark, sf_dir):
    return G.assigned(_chain(spark, sf_dir))


@query("unassigned", f"SELECT CAST(c_custkey AS VARCHAR) AS sequence_id, {hexed('c_custkey')} AS sequence_input FROM (SELECT * FROM {CHAIN} WHERE v_call IS NULL OR j_call IS NULL)")
def unassigned(spark, sf_dir):
    rows = _chain(spark, sf_dir).withColumn("sequence_id", F.col("c_custkey").cast("string")).withColumn("sequence_input", F.translate(digits(F.col("c_custkey")), HEX, PLAIN))
    return G.unassigned(rows)


SLICES = f"SELECT l_orderkey, l_linenumber, l_quantity, {hexed('l_orderkey')} AS s, CAST(1 + l_partkey % 30 AS INT) AS a, CAST(1 + l_suppkey % 64 AS INT) AS b FROM lineitem"


def _slices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.translate(digits(F.col("l_orderkey")), HEX, PLAIN).alias("s"), (1 + F.col("l_partkey") % 30).cast("int").alias("a"), (1 + F.col("l_suppkey") % 64).cast("int").alias("b"))


@query("query_slices", f"SELECT l_orderkey, l_linenumber, CASE WHEN a > b THEN substr(s, 1, b) ELSE substr(s, b + 1) END AS j, CASE WHEN a > b THEN substr(s, a + 1) ELSE substr(s, 1, a) END AS d FROM ({SLICES})")
def query_slices(spark, sf_dir):
    s, a, b = F.col("s"), F.col("a"), F.col("b")
    return _slices(spark, sf_dir).select("l_orderkey", "l_linenumber", S.j_query(s, a, b).alias("j"), S.d_query(s, a, b).alias("d"))


@query("j_eligible", f"SELECT CAST(l_orderkey AS VARCHAR) AS query, CASE WHEN a > b THEN substr(s, 1, b) ELSE substr(s, b + 1) END AS seq FROM ({SLICES}) WHERE length(CASE WHEN a > b THEN substr(s, 1, b) ELSE substr(s, b + 1) END) >= 14")
def j_eligible(spark, sf_dir):
    return G.j_queries(_slices(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("v_query"), F.col("s").alias("v_qseq"), F.col("a").alias("v_qstart"), F.col("b").alias("v_qend")))


@query("d_eligible", f"SELECT CAST(l_orderkey AS VARCHAR) AS query, CASE WHEN a > b THEN substr(s, a + 1) ELSE substr(s, 1, a) END AS seq FROM ({SLICES}) WHERE l_quantity > 25 AND abs(a - b) >= 5 AND CASE WHEN a > b THEN substr(s, a + 1) ELSE substr(s, 1, a) END <> ''")
def d_eligible(spark, sf_dir):
    call = F.when(F.col("l_quantity") > 25, F.lit("IGHV1-2*01")).otherwise(F.lit("IGKV1-39*01"))
    return G.d_queries(_slices(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("v_query"), call.alias("v_call"), F.col("l_orderkey").alias("j_query"), F.col("s").alias("j_qseq"), F.col("a").alias("j_qstart"), F.col("b").alias("j_qend")))


# --- files and identifiers -----------------------------------------------

FILE = "replace(lower(p_name), ' ', '-') || '_x_S' || p_size || '_L00' || (1 + p_partkey % 4) || '_' || substr('R1R2I1', 1 + 2 * CAST(p_partkey % 3 AS INT), 2) || '_001'"


def _files(spark, sf_dir):
    name = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lit("_x_S"), F.col("p_size"), F.lit("_L00"), 1 + F.col("p_partkey") % 4, F.lit("_"), F.substring(F.lit("R1R2I1"), (1 + 2 * (F.col("p_partkey") % 3)).cast("int"), F.lit(2)), F.lit("_001"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("f"))


def _part(i: int) -> str:
    return f"list_extract(p, {i})"


@query("fastq_name_illumina", f"SELECT p_partkey, array_to_string(p[1:len(p) - 4], '_') AS name, {_part(-4)} AS sample, {_part(-3)} AS lane, {_part(-2)} AS read, {_part(-1)} AS number FROM (SELECT p_partkey, string_split({FILE}, '_') AS p FROM part)")
def fastq_name_illumina(spark, sf_dir):
    return _files(spark, sf_dir).select("p_partkey", *[c.alias(k) for k, c in M.name_fields(F.col("f")).items()])


@query("fastq_name_element", f"SELECT p_partkey, array_to_string(p[1:len(p) - 1], '_') AS name, {_part(-1)} AS read FROM (SELECT p_partkey, string_split({FILE}, '_') AS p FROM part)")
def fastq_name_element(spark, sf_dir):
    return _files(spark, sf_dir).select("p_partkey", *[c.alias(k) for k, c in M.name_fields(F.col("f"), "element").items()])


@query("pair_grouping", f"SELECT name, lane, CAST(count(*) AS BIGINT) AS files FROM (SELECT array_to_string(p[1:len(p) - 4], '_') AS name, {_part(-3)} AS lane, {_part(-2)} AS read FROM (SELECT string_split({FILE}, '_') AS p FROM part)) WHERE read IN ('R1', 'R2') GROUP BY ALL")
def pair_grouping(spark, sf_dir):
    f = M.name_fields(F.col("f"))
    return _files(spark, sf_dir).select(*[f[k].alias(k) for k in ("name", "lane", "read")]).filter(F.col("read").isin("R1", "R2")).groupBy("name", "lane").agg(F.count(F.lit(1)).alias("files"))


UMI_SQL = f"(SELECT o_orderkey, {hexed('o_orderkey')} AS s FROM orders)"


def _umi(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.translate(digits(F.col("o_orderkey")), HEX, PLAIN).alias("s"))


@query("umi_slice", f"SELECT o_orderkey, left(s, 8) AS first, right(s, 6) AS last FROM {UMI_SQL}")
def umi_slice(spark, sf_dir):
    return _umi(spark, sf_dir).select("o_orderkey", U.umi_slice(F.col("s"), 8).alias("first"), U.umi_slice(F.col("s"), -6).alias("last"))


@query("umi_leading", f"SELECT o_orderkey, CASE WHEN strpos(s, 'ACG') > 0 AND length(substr(s, strpos(s, 'ACG') + 3, 12)) = 12 THEN substr(s, strpos(s, 'ACG') + 3, 12) END AS umi FROM {UMI_SQL}")
def umi_leading(spark, sf_dir):
    return _umi(spark, sf_dir).select("o_orderkey", U.umi_exact(F.col("s"), leading="ACG", length=12).alias("umi"))


@query("umi_trailing", f"SELECT o_orderkey, CASE WHEN strpos(s, 'ACG') > 12 THEN substr(s, strpos(s, 'ACG') - 12, 12) END AS umi FROM {UMI_SQL}")
def umi_trailing(spark, sf_dir):
    return _umi(spark, sf_dir).select("o_orderkey", U.umi_exact(F.col("s"), trailing="ACG", length=12).alias("umi"))


@query("umi_flanked", f"SELECT o_orderkey, CASE WHEN a > 0 AND strpos(r, 'TTA') > 0 THEN left(r, strpos(r, 'TTA') - 1) END AS umi FROM (SELECT *, strpos(s, 'ACG') AS a, substr(s, strpos(s, 'ACG') + 3) AS r FROM {UMI_SQL})")
def umi_flanked(spark, sf_dir):
    return _umi(spark, sf_dir).select("o_orderkey", U.umi_exact(F.col("s"), leading="ACG", trailing="TTA").alias("umi"))


@query("umi_multi", f"SELECT o_orderkey, nullif(array_to_string(list_filter([CASE WHEN strpos(s, 'AACC') > 10 THEN substr(s, strpos(s, 'AACC') - 10, 10) END, CASE WHEN strpos(s, 'GGTT') > 10 THEN substr(s, strpos(s, 'GGTT') - 10, 10) END], lambda x: x IS NOT NULL), '+'), '') AS umi FROM {UMI_SQL}")
def umi_multi(spark, sf_dir):
    return _umi(spark, sf_dir).select("o_orderkey", U.joined(U.umi_exact(F.col("s"), trailing="AACC", length=10), U.umi_exact(F.col("s"), trailing="GGTT", length=10)).alias("umi"))


# --- kernels (no SQL) ----------------------------------------------------


def _aligned(mode: str):
    @query(f"{mode}_align")
    def run(spark, sf_dir):
        read, germ, _, _ = cols()
        import pyarrow as pa

        rows = pairs(spark, sf_dir).select("o_orderkey", F.replace(read, F.lit("-"), F.lit("")).alias("q"), F.replace(germ, F.lit("-"), F.lit("")).alias("g"))

        def each(batches):
            for b in batches:
                found = align(list(zip(b["q"].to_pylist(), b["g"].to_pylist())), mode, Params(gap_open=-8))
                yield pa.record_batch([b["o_orderkey"], pa.array([x.score for x in found], pa.int32()), pa.array([x.aligned_query for x in found]), pa.array([x.aligned_target for x in found])], ["o_orderkey", "score", "aligned_query", "aligned_target"])

        return rows.mapInArrow(each, "o_orderkey long, score int, aligned_query string, aligned_target string")


for _mode in ("local", "semiglobal", "global"):
    _aligned(_mode)


@query("assign")
def assign(spark, sf_dir):
    """A read for each benchmark item, assigned against the synthetic germline."""
    reads = Y.reads(table(spark, sf_dir, "benchmark"), "item_id").select("sequence_id", "sequence_input", "quality")
    return G.assign(G.spread(reads), Y.germline(spark))


@query("annotate")
def annotate(spark, sf_dir):
    """The same, annotated: all output columns and ``error``."""
    return A.annotate(G.assigned(assign(spark, sf_dir)), Y.germline(spark), A.AnnotateParams(germline_database="synthetic"))


from cloneweave.plans import truth as _truth  # noqa: E402,F401  registers its queries here
