"""Germline databases: a table (db, receptor, segment, allele, species, seq, gapped).

Built from FASTA and AIRR JSON files; V genes without IMGT gaps take them from
the best semiglobal match among gapped V genes.  Stored as Parquet,
partitioned by receptor, database and segment.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneweave.operators.align import Params, align
from cloneweave.schema import GERMLINE
from cloneweave.sources.fastx import natural, read_fastx

SEGMENTS = "vdjc"
RECEPTORS = ("bcr", "tcr")
GAPS = Params(match=3, mismatch=-2, gap_open=-25, gap_extend=-1)


def segment(allele: Column, constant: bool = False) -> Column:
    """From the fourth letter; A, G, E and M are constant genes."""
    letter = F.lower(F.substring(allele, 4, 1))
    return F.lit("c") if constant else F.when(letter.isin("a", "g", "e", "m", "c"), F.lit("c")).when(letter.isin("v", "d", "j"), letter)


def from_fasta(spark: SparkSession, path: str, keep_species: bool = True) -> DataFrame:
    """allele, gapped."""
    rows = read_fastx(spark, path)
    name = F.col("sequence_id") if keep_species else F.substring_index("sequence_id", "__", 1)
    return rows.select(name.alias("allele"), F.col("sequence_input").alias("gapped"))


def from_json(spark: SparkSession, path: str, keep_species: bool = True) -> DataFrame:
    """allele, gapped of an AIRR germline set; V genes take the IMGT delineation's aligned sequence."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("GermlineSet").alias("s")).select(F.explode("s.allele_descriptions").alias("a"))
    species = F.regexp_replace(F.lower("a.species.label"), " ", "_")
    imgt = F.get(F.filter("a.v_gene_delineations", lambda d: d["delineation_scheme"] == "IMGT"), 0)["aligned_sequence"]
    seq = F.when(F.col("a.sequence_type") == "V", F.coalesce(imgt, F.col("a.coding_sequence"))).otherwise(F.col("a.coding_sequence"))
    name = F.concat_ws("__", F.col("a.label"), species) if keep_species else F.col("a.label")
    return rows.select(name.alias("allele"), F.upper(seq).alias("gapped"))


def add_imgt_gaps(alleles: list[tuple[str, str]], reference: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """V genes with gaps from the best of the reference's; as they are if any V gene has gaps.  V genes come first."""
    v = [(n, s) for n, s in alleles if n[3:4].upper() == "V"]
    rest = [(n, s) for n, s in alleles if n[3:4].upper() != "V"]
    if any("." in s for _, s in v) or not v:
        return list(alleles)
    models = sorted(((n, s) for n, s in reference if n.startswith("IGHV") and "." in s), key=lambda x: natural(x[0]))
    if not models:
        raise ValueError("no gapped V gene to take gaps from")
    out = []
    for name, seq in v:
        found = align([(seq, s.replace(".", "?")) for _, s in models], "semiglobal", GAPS)
        best = max(range(len(found)), key=lambda i: (found[i].score, -i))
        out.append((name, found[best].aligned_query.replace("-", ".").rstrip(".")))
    return out + rest


def table(spark: SparkSession, alleles: DataFrame, db: str, receptor: str, constants: DataFrame | None = None) -> DataFrame:
    """The germline table of allele, gapped rows."""
    if receptor not in RECEPTORS:
        raise ValueError(f"receptor is one of {', '.join(RECEPTORS)}, not {receptor}")
    rows = alleles.withColumn("segment", segment(F.col("allele")))
    if constants is not None:
        rows = rows.unionByName(constants.withColumn("segment", F.lit("c")))
    species = F.when(F.instr("allele", "__") > 0, F.substring_index("allele", "__", -1)).otherwise(F.lit(db.lower()))
    return rows.select(F.lit(db.lower()).alias("db"), F.lit(receptor).alias("receptor"), "segment", "allele", species.alias("species"), F.replace("gapped", F.lit("."), F.lit("")).alias("seq"), "gapped")


def build_germline_database(spark: SparkSession, name: str, fastas=(), constants=(), jsons=(), receptor: str = "bcr", reference: DataFrame | None = None, location: str | None = None, keep_species: bool = True, overwrite: bool = False) -> str:
    """Build and write a database; returns its folder.  A reference of gapped V genes is needed when none has gaps."""
    parts = [from_fasta(spark, f, keep_species) for f in fastas] + [from_json(spark, f, keep_species) for f in jsons]
    if not parts and not constants:
        raise ValueError("no input file")
    genes = parts[0] if parts else spark.createDataFrame([], "allele string, gapped string")
    for x in parts[1:]:
        genes = genes.unionByName(x)
    if reference is not None:
        rows = [(r["allele"], r["gapped"]) for r in genes.collect()]  # a reference table, not data
        genes = spark.createDataFrame(add_imgt_gaps(rows, [(r["allele"], r["gapped"]) for r in reference.collect()]), "allele string, gapped string")
    extra = None
    for f in constants:
        x = from_fasta(spark, f, keep_species)
        extra = x if extra is None else extra.unionByName(x)
    rows = table(spark, genes, name, receptor, extra)
    where = os.path.join(location or os.path.expanduser("~/.cloneweave/germline_dbs"), receptor, name.lower())
    rows.drop("db", "receptor").write.mode("overwrite" if overwrite else "error").partitionBy("segment").parquet(where)
    with_manifest = spark.createDataFrame([("fasta", str(f)) for f in fastas] + [("constants", str(f)) for f in constants] + [("json", str(f)) for f in jsons], "kind string, file string")
    with_manifest.write.mode("overwrite").parquet(where + "_manifest")
    return where


def get_germline_database_path(name: str, receptor: str = "bcr", location: str | None = None) -> str:
    receptor, name = receptor.lower(), name.lower()
    if receptor not in RECEPTORS:
        raise ValueError(f"receptor is one of {', '.join(RECEPTORS)}, not {receptor}")
    where = os.path.join(location or os.path.expanduser("~/.cloneweave/germline_dbs"), receptor, name)
    if not os.path.isdir(where):
        raise FileNotFoundError(f"there is no germline database {name} for {receptor}")
    return where


def load(spark: SparkSession, name: str, receptor: str = "bcr", location: str | None = None) -> DataFrame:
    rows = spark.read.parquet(get_germline_database_path(name, receptor, location))
    return rows.select(F.lit(name.lower()).alias("db"), F.lit(receptor).alias("receptor"), "segment", "allele", "species", "seq", "gapped").to(spark.createDataFrame([], GERMLINE).schema)


def matching(germline: DataFrame, gene: str, exact: bool = False, force_constant: bool = False) -> DataFrame:
    """Alleles that are called ``gene``, or have it in their name."""
    if not isinstance(gene, str) or len(gene) < 4:
        raise ValueError(f"{gene!r} is no gene name")
    letter = gene[3].lower()
    seg = "c" if force_constant or letter in "agem" else letter
    if seg not in SEGMENTS:
        raise ValueError(f"{gene} is of no known segment")
    rows = germline.filter(F.col("segment") == seg)
    return rows.filter(F.col("allele") == gene) if exact else rows.filter(F.col("allele").contains(gene))


def get_germline(germline: DataFrame, gene: str, imgt_gapped: bool = False, exact_match: bool = False, force_constant: bool = False, truncate_species: bool = True):
    """(allele, sequence) of the one match, or a list in natural order; ValueError without a match."""
    rows = matching(germline, gene, exact_match, force_constant).select("allele", "gapped" if imgt_gapped else "seq").collect()
    found = sorted(((r[0].split("__")[0] if truncate_species else r[0], r[1]) for r in rows), key=lambda x: natural(x[0]))
    if not found:
        raise ValueError(f"no germline gene matches {gene}")
    return found[0] if len(found) == 1 else found
