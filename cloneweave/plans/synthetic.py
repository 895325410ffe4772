"""A small germline and reads made from text, for queries over tables that hold no nucleotides.

Genes are drawn from seeded random bases with the landmarks that annotation
needs: V genes of 104 codons with IMGT gaps and a conserved C, J genes with W or
F and G.G, D and C genes.  Reads recombine them; everything depends only on
the row's id, so any task makes the same read.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneweave.functions.sequence import CODONS, revcomp_text
from cloneweave.schema import GERMLINE

SENSE = sorted(c for c, a in CODONS.items() if a not in "*C")
# Codons of an IMGT-gapped V gene that are gaps here.
GAPPED = set(range(31, 35)) | {60, 61, 73}


def genes(seed: int = 5) -> list[tuple[str, str, str, str]]:
    """(segment, allele, ungapped, gapped)."""
    out = []
    for locus in ("IGH", "IGK"):
        for i in range(1, 7):
            rng = random.Random(f"{seed}{locus}V{i}")
            base = [rng.choice(SENSE) for _ in range(104)]
            base[103] = "TGT"
            for allele in (1, 2):
                codons = list(base)
                for k in rng.sample(range(5, 100), 4 * (allele - 1)):
                    codons[k] = rng.choice(SENSE)
                gapped = "".join("..." if k in GAPPED else c for k, c in enumerate(codons)) + rng.choice(SENSE) + "GA"
                out.append(("v", f"{locus}V{i}-1*0{allele}__homo_sapiens", gapped.replace(".", ""), gapped))
        for i in range(1, 5):
            rng = random.Random(f"{seed}{locus}J{i}")
            start = "".join(rng.choice("ACGT") for _ in range(6 + i))
            tail = ("TGG" if locus == "IGH" else "TTC") + "GGC" + rng.choice(SENSE) + "GGA" + "".join(rng.choice(SENSE) for _ in range(6 if locus == "IGK" else 7)) + "G"
            out.append(("j", f"{locus}J{i}*01__homo_sapiens", start + tail, start + tail))
    for i in range(1, 6):
        rng = random.Random(f"{seed}IGHD{i}")
        seq = "".join(rng.choice("ACGT") for _ in range(18 + i))
        out.append(("d", f"IGHD{i}-1*01__homo_sapiens", seq, seq))
    for name in ("IGHM", "IGHG1", "IGKC"):
        rng = random.Random(f"{seed}{name}")
        seq = "".join(rng.choice(SENSE) for _ in range(40))
        out.append(("c", f"{name}*01", seq, seq))
    return out


def germline(spark: SparkSession) -> DataFrame:
    rows = [("synthetic", "bcr", s, a, a.split("__")[1] if "__" in a else "synthetic", seq, gapped) for s, a, seq, gapped in genes()]
    return spark.createDataFrame(rows, GERMLINE)


def read(key: int, known: list[tuple[str, str, str, str]]) -> dict:
    """A recombined read and how it was made."""
    rng = random.Random(key * 7919 + 13)
    locus = rng.choice(["IGH", "IGH", "IGK"])
    of = lambda s: [g for g in known if g[0] == s and g[1].startswith(locus)]
    v, j = rng.choice(of("v")), rng.choice(of("j"))
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    v_seq = v[2][: len(v[2]) - rng.randint(0, 3)]
    v_seq = list(v_seq)
    mutations = rng.sample(range(10, 250), rng.randint(0, 12))
    for i in mutations:
        v_seq[i] = rng.choice([b for b in "ACGT" if b != v_seq[i]])
    d = rng.choice(of("d")) if locus == "IGH" else None
    body = "".join(v_seq) + bases(rng.randint(0, 8)) + (d[2] + bases(rng.randint(0, 8)) if d else "") + j[2]
    c = rng.choice([g for g in known if g[0] == "c" and g[1].startswith(locus)])
    body += c[2] if rng.random() < 0.5 else ""
    reverse = rng.random() < 0.5
    return {"sequence_id": f"r{key}", "sequence_input": revcomp_text(body) if reverse else body, "quality": "", "v": v[1], "d": d and d[1], "j": j[1], "rev_comp": reverse, "mutations": len(mutations)}


def reads(keys: DataFrame, column: str) -> DataFrame:
    """A read for each key."""
    import pyarrow as pa

    known = genes()
    kinds = pa.schema([("sequence_id", pa.string()), ("sequence_input", pa.string()), ("quality", pa.string()), ("true_v", pa.string()), ("true_d", pa.string()), ("true_j", pa.string()), ("true_rev", pa.bool_()), ("true_mutations", pa.int32())])

    def run(batches):
        for b in batches:
            rows = [read(k, known) for k in b.column(0).to_pylist() if k is not None]
            yield pa.RecordBatch.from_pylist([{"sequence_id": r["sequence_id"], "sequence_input": r["sequence_input"], "quality": r["quality"], "true_v": r["v"], "true_d": r["d"], "true_j": r["j"], "true_rev": r["rev_comp"], "true_mutations": r["mutations"]} for r in rows], schema=kinds)

    return keys.select(F.col(column).cast("long")).mapInArrow(run, "sequence_id string, sequence_input string, quality string, true_v string, true_d string, true_j string, true_rev boolean, true_mutations int")
