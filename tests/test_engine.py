"""Sources, germlines, assignment, annotation, UMIs, merging, API, CLI and streaming on synthetic reads."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cloneweave import api, cli
from cloneweave.functions.regions import REGIONS
from cloneweave.functions.sequence import revcomp_text
from cloneweave.operators import annotate as A
from cloneweave.operators import assign as G
from cloneweave.operators import merge as M
from cloneweave.operators.umi import UmiPattern, find_umi, parse_umis, patterns
from cloneweave.plans import synthetic as Y
from cloneweave.schema import OUTPUT
from cloneweave.sources import fastx
from cloneweave.sources import germline as D


@pytest.fixture(scope="module")
def annotated(spark):
    keys = spark.range(24).withColumnRenamed("id", "k")
    reads = Y.reads(keys, "k")
    germ = Y.germline(spark)
    calls = G.assign(reads.select("sequence_id", "sequence_input", "quality"), germ)
    rows = A.annotate(G.assigned(calls), germ).join(reads.drop("sequence_input", "quality"), "sequence_id").collect()
    return rows


def test_calls_and_strand(annotated):
    assert len(annotated) == 24
    for r in annotated:
        assert r["error"] is None and r["rev_comp"] == r["true_rev"]
        assert r["v_gene"] == r["true_v"].split("*")[0]
        assert r["j_call"] == r["true_j"].split("__")[0]


def test_invariants(annotated):
    for r in annotated:
        parts = "".join(r[x] for x in REGIONS)
        assert r["sequence"].startswith(parts[:-3])
        for a, b in (("sequence_alignment", "sequence"), ("germline_alignment", "germline"), ("sequence_alignment_aa", "sequence_aa")):
            assert r[a].replace("-", "") == r[b]
        assert len(r["cdr_mask"]) == len(r["gene_segment_mask"]) == len(r["nongermline_mask"]) == len(parts)
        assert r["cdr3"] == "".join(r[f"cdr3_{x}"] for x in ("v", "n1", "d", "n2", "j"))
        assert r["v_mutation_count"] <= r["true_mutations"] + 8
        assert r["junction"].startswith("TG") and r["junction_aa"][0] == "C"
        assert r["v_sequence"] == r["sequence_oriented"][r["v_sequence_start"] : r["v_sequence_end"]]


def test_schema_has_all_columns():
    kinds = [f.dataType.simpleString() for f in OUTPUT.fields]
    assert len(kinds) == 147
    assert {k: kinds.count(k) for k in set(kinds)} == {"string": 103, "bigint": 23, "double": 16, "boolean": 5}


def test_failures_are_rows(spark):
    germ = Y.germline(spark)
    calls = spark.createDataFrame([("a", "ACGT", "", False, "IGHV9-9*01", 0.0, None, None, "IGHJ1*01__homo_sapiens", 0.0, None, None)], G.ASSIGNMENT)
    (r,) = A.annotate(calls, germ).collect()
    assert "IGHV9-9*01" in r["error"] and r["sequence_id"] == "a"
    assert A.succeeded(A.annotate(calls, germ)).count() == 0 and A.failed(A.annotate(calls, germ)).count() == 1


def test_duplicate_ids_and_unassigned(spark):
    germ = Y.germline(spark)
    good = Y.read(1, Y.genes())["sequence_input"]
    reads = spark.createDataFrame([("x", good, ""), ("x", good, ""), ("n", "ACGTACGTACGTAAAA" * 3, "")], "sequence_id string, sequence_input string, quality string")
    calls = G.assign(reads, germ)
    assert G.assigned(calls).count() == 2
    assert [r["sequence_id"] for r in G.unassigned(calls).collect()] == ["n"]


def test_fastx(spark, tmp_path):
    records = [(f"r{i}", "ACGT" * (i % 7 + 1)) for i in range(500)]
    (tmp_path / "a.fasta").write_text("".join(f">{n} note\n{s[:5].lower()}\n{s[5:]}\n" for n, s in records))
    got = fastx.read_fastx(spark, str(tmp_path / "a.fasta"), 1000)
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted(records) and got.first()["sample"] == "a"
    quality = lambda s: "@" + "I" * (len(s) - 1)  # noqa: E731  like a header
    text = "".join(f"@{n} x\n{s}\n+\n{quality(s)}\n" for n, s in records)
    (tmp_path / "b.fastq").write_text(text)
    assert sorted((r[0], r[1], r[2]) for r in fastx.read_fastx(spark, str(tmp_path / "b.fastq"), 777).collect()) == sorted((n, s, quality(s)) for n, s in records)
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as f:
        f.write(text)
    assert fastx.read_fastx(spark, str(tmp_path / "c.fastq.gz")).count() == 500
    assert [p.rsplit("/", 1)[1] for p in fastx.inputs(str(tmp_path))] == ["a.fasta", "b.fastq", "c.fastq.gz"]
    with pytest.raises(ValueError):
        fastx.reads_of(spark, 12345)


@pytest.mark.parametrize("first", [">", "@", "+", "I"])
def test_fastq_ranges(tmp_path, first):
    """Every range size gives every read once, whatever the quality lines begin with."""
    kinds = {">": ">@+", "@": "@>+", "+": "+>@", "I": "I"}[first]
    want = [(f"r{i}", "ACGT" * (i % 5 + 1), (kinds[i % len(kinds)] + "I" * 19)[: 4 * (i % 5 + 1)]) for i in range(60)] + [("last", "A", ">")]
    path = tmp_path / "x.fastq"
    path.write_text("".join(f"@{n} >x\n{s}\n+{n if i % 3 else ''}\n{q}\n" for i, (n, s, q) in enumerate(want)))
    size = path.stat().st_size
    for step in [*range(1, 140), 500, size - 1, size, size + 1]:
        reader = fastx.FastxReader({"path": str(path), "rangeBytes": str(step)})
        assert [r[:3] for part in reader.partitions() for r in reader.read(part)] == want, step


def test_fasta_ranges(tmp_path):
    want = [(f"r{i}", "ACGT" * (i % 5 + 1), "") for i in range(40)]
    path = tmp_path / "x.fasta"
    path.write_text("".join(f">{n} @x\n{s[:4]}\r\n{s[4:].lower()}\n\n" for n, s, _ in want))
    for step in [*range(1, 90), 1000]:
        reader = fastx.FastxReader({"path": str(path), "rangeBytes": str(step)})
        assert [r[:3] for part in reader.partitions() for r in reader.read(part)] == want, step


def test_germlines(spark, tmp_path):
    germ = Y.germline(spark)
    (tmp_path / "g.fasta").write_text("".join(f">{r['allele']}\n{r['gapped']}\n" for r in germ.filter("segment <> 'c'").collect()))
    (tmp_path / "c.fasta").write_text("".join(f">{r['allele']}\n{r['gapped']}\n" for r in germ.filter("segment = 'c'").collect()))
    D.build_germline_database(spark, "Mine", [str(tmp_path / "g.fasta")], [str(tmp_path / "c.fasta")], location=str(tmp_path / "db"))
    back = D.load(spark, "mine", location=str(tmp_path / "db"))
    assert {(r["allele"], r["seq"], r["segment"]) for r in back.collect()} == {(r["allele"], r["seq"], r["segment"]) for r in germ.collect()}
    assert len(D.get_germline(back, "IGHV1-1")) == 2
    for wrong in ("IGHV1-1", "IGHV99-1*01"):
        with pytest.raises(ValueError):
            D.get_germline(back, wrong, exact_match=True)
    with pytest.raises(ValueError):
        D.get_germline_database_path("mine", "xyz")
    with pytest.raises(FileNotFoundError):
        D.get_germline_database_path("none", location=str(tmp_path))
    v = [(r["allele"], r["gapped"]) for r in germ.filter("segment = 'v'").collect()]
    assert dict(D.add_imgt_gaps([(a, g.replace(".", "")) for a, g in v if a.startswith("IGHV")], v)) == {a: g for a, g in v if a.startswith("IGHV")}


def test_germline_json(spark, tmp_path):
    gene = {"label": "IGHV1-2*02", "sequence_type": "V", "coding_sequence": "ACG", "species": {"label": "Homo sapiens"}, "v_gene_delineations": [{"delineation_scheme": "IMGT", "aligned_sequence": "A.CG"}]}
    (tmp_path / "g.json").write_text(json.dumps({"GermlineSet": [{"allele_descriptions": [gene, gene | {"label": "IGHJ4*02", "sequence_type": "J"}]}]}))
    assert {tuple(r) for r in D.from_json(spark, str(tmp_path / "g.json")).collect()} == {("IGHV1-2*02__homo_sapiens", "A.CG"), ("IGHJ4*02__homo_sapiens", "ACG")}


def test_umis(spark):
    assert find_umi("ATGCAAAACCCC", UmiPattern("ATGC[UMI]", 4)) == "AAAA"
    assert find_umi("NNNNNNATGC", UmiPattern("[UMI]ATGC", 6)) == "NNNNNN"
    assert find_umi("ATGCGGGGTTAATTAA", UmiPattern("ATGC[UMI]TTAATTAA")) == "GGGG"
    assert find_umi(revcomp_text("ATGCAAAACCCC"), UmiPattern("ATGC[UMI]", -4)) == "AAAA"
    assert find_umi("ACGTACGTACGT", UmiPattern(None, 4)) == "ACGT" == find_umi("ACGTACGTACGT", UmiPattern(None, -4))
    assert patterns("smartseq-human-bcr", None)[0].mismatches == 2
    with pytest.raises(ValueError):
        patterns(["A[UMI]", "C[UMI]"], [1, 2, 3])
    rows = spark.createDataFrame([("s1", "ATGCAAAA", ""), ("s2", "ATGCGGGG", ""), ("s3", "CC", "")], "sequence_id string, sequence_input string, quality string")
    assert sorted(r["sequence_id"] for r in parse_umis(rows, "ATGC[UMI]", 4, 0).collect()) == ["s1_AAAA", "s2_GGGG"]
    assert parse_umis(rows, "ATGC[UMI]", 4, 0, drop=False).count() == 3


def test_umis_of_files_and_sequences(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">s1\nATGCAAAA\n>s2\nATGCGGGG\n>s3\nCC\n")
    assert parse_umis(str(tmp_path / "in.fasta"), "ATGC[UMI]", 4, 0, output_file=str(tmp_path / "out")) is None
    assert sorted((r[0], r[1]) for r in fastx.read_fastx(spark, str(tmp_path / "in.fasta")).collect())[0] == ("s1", "ATGCAAAA")
    lines = sorted(x for f in (tmp_path / "out").glob("part*") for x in f.read_text().split())
    assert lines == [">s1_AAAA", ">s2_GGGG", "ATGCAAAA", "ATGCGGGG"]
    got = parse_umis([("a", "ATGCAAAA"), ("b", "CC")], "ATGC[UMI]", 4, 0)
    assert [(r["sequence_id"], r["umi"]) for r in got.collect()] == [("a_AAAA", "AAAA")]
    assert parse_umis("ATGCTTTT", "ATGC[UMI]", 4, 0)["umi"] == "TTTT" and parse_umis(("x", "CC"), "ATGC[UMI]", 4, 0)["umi"] is None
    with pytest.raises(ValueError):
        parse_umis("ATGC", "ATGC[UMI]", 4, fmt="xml")


def test_merging(spark, tmp_path):
    import random

    rng = random.Random(3)
    whole = {f"p{i}": "".join(rng.choice("ACGT") for _ in range(90)) for i in range(20)}
    for read, cut in (("R1", lambda s: s[:65]), ("R2", lambda s: revcomp_text(s[25:]))):
        for lane, part in (("L001", 0), ("L002", 1)):
            rows = [(n, cut(s)) for k, (n, s) in enumerate(whole.items()) if k % 2 == part]
            (tmp_path / f"my_run_S1_{lane}_{read}_001.fastq").write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in rows))
    (tmp_path / "my_run_S1_L001_I1_001.fastq").write_text("@i\nA\n+\nI\n")
    groups = M.group_paired_fastqs(str(tmp_path))
    assert list(groups) == ["my_run"] and list(groups["my_run"]) == ["L001", "L002"]
    assert {r["sequence_id"]: r["sequence_input"] for r in M.merge_fastqs(spark, str(tmp_path)).collect()} == whole
    (report,) = M.merge_report(spark, str(tmp_path)).collect()
    assert (report["sample"], report["pairs"], report["merged"], report["bases_in"], report["bases_out"], report["mean_quality"]) == ("my_run", 20, 20, 2600, 1800, 40.0)
    seeds = M.TRUSEQ[0][:8]
    assert M._adapter("ACGT" + seeds + "C" * 25 + M.TRUSEQ[0], M.TRUSEQ[0], M.MergeParams()) == 37
    assert M.merge_pair("A" * 40, "I" * 40, "C" * 40, "I" * 40, M.MergeParams()) is None
    (tmp_path / "inter.fastq").write_text("".join(f"@{n}/{k}\n{s}\n+\n{'I' * len(s)}\n" for n, x in whole.items() for k, s in ((1, x[:65]), (2, revcomp_text(x[25:])))))
    assert {r["sequence_id"]: r["sequence_input"] for r in M.merge_fastqs(spark, [str(tmp_path / "inter.fastq")], interleaved=True).collect()} == whole


def test_run_and_sinks(spark, tmp_path):
    germ = Y.germline(spark)
    reads = [(f"q{k}", Y.read(k, Y.genes())["sequence_input"]) for k in range(3)] + [("none", "ACGT" * 10)]
    assert api.run(spark, reads, str(tmp_path / "out"), germ, output_format=("airr", "parquet"), debug=True) is None
    assert spark.read.parquet(str(tmp_path / "out/parquet")).count() == 3
    tsv = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/airr"))
    assert tsv.count() == 3 and set(OUTPUT.names) <= set(tsv.columns)
    assert [r["sequence_id"] for r in spark.read.option("header", True).csv(str(tmp_path / "out/unassigned")).collect()] == ["none"]
    one = api.run(spark, reads[:1], germline_database=germ, as_dataframe=False)
    assert one["sequence_id"] == "q0" and one["germline_database"] == "custom"


def test_samples_and_summary(spark, tmp_path, capsys):
    germ, genes = Y.germline(spark), Y.genes()
    (tmp_path / "in").mkdir()
    for name, keys in (("one", (1, 2)), ("two", (2, 3, 4))):
        (tmp_path / "in" / f"{name}.fasta").write_text("".join(f">q{k}\n{Y.read(k, genes)['sequence_input']}\n" for k in keys) + f">none\n{'ACGT' * 10}\n")
    api.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), germ, output_format=("airr", "parquet"), verbose=True)
    for kind in ("airr", "parquet"):
        assert sorted(p.name for p in (tmp_path / "out" / kind).iterdir() if p.is_dir()) == ["sample=one", "sample=two"]
    rows = spark.read.parquet(str(tmp_path / "out/parquet")).collect()
    assert sorted((r["sample"], r["sequence_id"]) for r in rows) == [("one", "q1"), ("one", "q2"), ("two", "q2"), ("two", "q3"), ("two", "q4")]
    assert spark.read.option("header", True).csv(str(tmp_path / "out/unassigned")).count() == 2
    summary = json.loads(spark.read.text(str(tmp_path / "out/log/summary")).first()[0])
    assert (summary["reads"], summary["annotated"]) == (7, 5) and "7 reads, 5 annotated" in capsys.readouterr().out


def test_interleaved_alone_merges(spark, tmp_path):
    germ = Y.germline(spark)
    s = Y.read(5, Y.genes())["sequence_input"]
    cut = len(s) // 2 + 40
    (tmp_path / "x.fastq").write_text("".join(f"@p/{k}\n{x}\n+\n{'I' * len(x)}\n" for k, x in ((1, s[:cut]), (2, revcomp_text(s[-cut:])))))
    (row,) = api.run(spark, str(tmp_path / "x.fastq"), germline_database=germ, interleaved_fastq=True).collect()
    assert row["sequence_input"] == s and row["sample"] == "x"


def test_another_assigner(spark):
    germ, genes = Y.germline(spark), Y.genes()
    r = Y.read(1, genes)

    def told(reads, germline):
        calls = {"v_call": r["v"], "j_call": r["j"], "d_call": r["d"], "c_call": None}
        out = reads.withColumn("rev_comp", F.lit(r["rev_comp"]))
        for seg in "vdjc":
            out = out.withColumn(f"{seg}_call", F.lit(calls[f"{seg}_call"]).cast("string")).withColumn(f"{seg}_support", F.lit(0.0))
        return out

    (row,) = api.run(spark, [("a", r["sequence_input"])], germline_database=germ, assigner=told).collect()
    assert row["v_gene"] == r["v"].split("*")[0] and row["v_support"] == 0.0


def test_recall_of_mutated_genes():
    """Share of planted genes found again, by mutated bases of the gene in the read."""
    import random

    rng, genes = random.Random(12), Y.genes()
    least = {("j", 0): 1.0, ("j", 3): 0.97, ("j", 6): 0.9, ("d", 0): 0.97, ("d", 2): 0.9, ("d", 4): 0.7, ("v", 30): 0.97}
    for (seg, changes), share in least.items():
        params = {"v": G.V, "j": G.J, "d": G.D}[seg]
        mine = [(a, s) for x, a, s, _ in genes if x == seg]
        index, queries, want = G.Index(mine, params), [], []
        for _ in range(150):
            a, s = rng.choice(mine)
            t = list(s)
            for i in rng.sample(range(len(t)), changes):
                t[i] = rng.choice([b for b in "ACGT" if b != t[i]])
            pad = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 10)))
            queries.append(pad() + "".join(t) + pad())
            want.append(a.split("*")[0])
        found = [G.best(h) for h in G.hits(queries, index)]
        assert sum(h is not None and h.target.split("*")[0] == w for h, w in zip(found, want)) / 150 >= share, (seg, changes)


def test_sql_functions(spark):
    api.register(spark)
    assert tuple(spark.sql("SELECT revcomp('AACG'), translate_nt('ATGTAA', 1), translate_nt('A', 1)").first()) == ("CGTT", "M*", "")
    assert [r["kmer"] for r in spark.sql("SELECT * FROM kmers('ACGT', 3)").collect()] == ["ACG", "CGT"]


def test_cli():
    assert cli.parse_dict("a=1,b=x") == {"a": "1", "b": "x"} and cli.typed({"a": "1", "b": "x"}) == {"a": 1, "b": "x"}
    a = cli.parser().parse_args(["run", "in", "out", "-o", "parquet", "--merge_kwargs", "overlap=20"])
    assert a.output_format == ["parquet"] and a.merge_kwargs == {"overlap": "20"} and a.copy_inputs_to_project


def test_stream(spark, tmp_path):
    from cloneweave.streaming.reads import annotate_stream

    germ = Y.germline(spark)
    Y.reads(spark.range(4).withColumnRenamed("id", "k"), "k").select("sequence_id", "sequence_input", "quality").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sequence_id string, sequence_input string, quality string").parquet(str(tmp_path / "in"))
    annotate_stream(stream, germ, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("error").isNull()).count() == 4
