"""Golden values of positions, variants, regions, masks, productivity and UMIs."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloneweave.functions import positions as P
from cloneweave.functions import regions as R
from cloneweave.functions import sequence as S
from cloneweave.functions import umi as U
from cloneweave.functions import variants as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("gapped,at,want", [("ATGCATGC....ATGCATGC", 8, 8), ("ATGCATGC....ATGCATGC", 9, 13), ("ATGCATGC....ATGCATGC", 16, 20), ("....ATGCATGCATGC", 1, 5), ("ATGC....ATGC....ATGC", 5, 9), ("ATGC....ATGC....ATGC", 9, 17), ("..AT", 0, 1), ("AT", 9, 2)])
def test_gapped_from_raw(spark, gapped, at, want):
    assert one(spark, P.gapped_from_raw(F.lit(at), F.lit(gapped))) == want == P.gapped_from_raw_text(at, gapped)


VARIANTS = [
    ("mutations", "ATGCTTCC", "ATGCATGC", "ATG.CAT...GC", 0, "6:A>T|11:G>C"),
    ("insertions", "ATGCGGGATGC", "ATGC---ATGC", "AT.GCA...TGC", 0, "5:3>GGG"),
    ("insertions", "ATGCAGGGCATAACC", "ATGCA---CAT--CC", "ATGCA...C..AT..CC", 0, "5:3>GGG|13:2>AA!"),
    ("deletions", "AT--A-G--C", "ATGCATGAGC", "ATGCATGAGC", 0, "3-4:2>GC!|6:1>T!|8-9:2>AG!"),
    ("insertions", "", "", "", 0, ""),
    ("deletions", "", "", "", 0, ""),
]


@pytest.mark.parametrize("kind,q,g,gapped,start,want", VARIANTS)
def test_variants(spark, kind, q, g, gapped, start, want):
    f = {"mutations": V.mutations, "insertions": V.insertions, "deletions": V.deletions}[kind]
    assert one(spark, f(F.lit(q), F.lit(g), F.lit(gapped), F.lit(start))) == want
    text = V.mutations_text(q, g, gapped, start) if kind == "mutations" else V.indels_text(q, g, gapped, start, kind[:-1])
    assert "|".join(text) == want


def test_offset_insertion(spark):
    q, g, gapped = "ATGCGGGATGC", "ATGC---ATGC", "A" * 10 + "AT.GCA...TGC"
    assert "|".join(V.indels_text(q, g, gapped, 10, "insertion")) == "15:3>GGG" == one(spark, V.insertions(F.lit(q), F.lit(g), F.lit(gapped), F.lit(10)))


def test_frameshift(spark):
    assert one(spark, V.frameshift(F.lit("5:3>GGG|13:2>AA!"), F.lit("")))
    assert not one(spark, V.frameshift(F.lit("5:1>G!"), F.lit("9:1>A!")))


@given(st.text("ACGTN", max_size=60))
def test_revcomp_twice(s):
    assert S.revcomp_text(S.revcomp_text(s)) == s


def test_translate(spark):
    for frame in (1, 2, 3):
        for s in ("", "AT", "ATGTAANNNAC", "TTTTTC"):
            assert one(spark, S.translate(F.lit(s), frame)) == S.translate_text(s, frame)
    assert S.translate_text("ATG...TAA", dots=True) == "M.*" == one(spark, S.translate(F.lit("ATG...TAA"), dots=True))


def test_cdr_mask(spark):
    sizes = dict(zip(R.REGIONS, (4, 5, 4, 3, 6, 5, 3)))
    mask = R.cdr_mask({r: F.repeat(F.lit("A"), n) for r, n in sizes.items()})
    assert one(spark, mask) == "000011111000022200000033333000"
    assert one(spark, R.mask_array(mask)) == list("000011111000022200000033333000")


@pytest.mark.parametrize("change,part", [({"aa": "CA*W"}, "stop codon"), ({"j": "AAAW"}, "conserved C"), ({"j": "CAAA"}, "conserved W"), ({"j": "CAAW", "l": "IGK"}, "conserved F"), ({"j": "CAAA", "l": None}, "conserved W/F"), ({"jc": "IGKJ1*01"}, "locus mismatch (IGHV1 and IGKJ1*01)"), ({"s": "ACN"}, "ambiguous nucleotide")])
def test_productivity(spark, change, part):
    x = {"s": "ACG", "aa": "CAAW", "v": "IGHV1", "jc": "IGHJ1*01", "j": "CAAW", "l": "IGH"}
    issues = lambda x: one(spark, R.productivity_issues(*(F.lit(x[k]) for k in ("s", "aa", "v", "jc", "j")), F.lit(x["l"]).cast("string"), F.lit(False)))
    assert issues(x) == []
    assert any(part in i for i in issues(x | change))


def test_umi_expressions(spark):
    s = F.lit("ACGTACGTACGT")
    assert one(spark, U.umi_slice(s, 4)) == "ACGT" == one(spark, U.umi_slice(s, -4))
    assert one(spark, U.umi_exact(F.lit("ATGCNNNNNNTTTT"), leading="ATGC", length=6)) == "NNNNNN"
    assert one(spark, U.umi_exact(F.lit("NNNNNNATGC"), trailing="ATGC", length=6)) == "NNNNNN"
    assert one(spark, U.umi_exact(F.lit("TTT"), trailing="ATGC", length=6)) is None
