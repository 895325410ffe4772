"""Command line: ``python -m cloneweave.cli run INPUT PROJECT`` and ``build_germline_database NAME``."""

from __future__ import annotations

import argparse


def parse_dict(text: str) -> dict[str, str]:
    """key1=val1,key2=val2."""
    out = {}
    for item in filter(None, text.split(",")):
        key, eq, value = item.partition("=")
        if not eq:
            raise argparse.ArgumentTypeError(f"{item!r} is not key=value")
        out[key.strip()] = value.strip()
    return out


def typed(values: dict[str, str]) -> dict:
    """Numbers where they are."""
    number = lambda v: int(v) if v.lstrip("-").isdigit() else float(v) if v.replace(".", "", 1).isdigit() else v
    return {k: number(v) for k, v in values.items()}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cloneweave")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    r.add_argument("input_path")
    r.add_argument("project_path")
    r.add_argument("--germline_database", default="human")
    r.add_argument("--germline_location")
    r.add_argument("--receptor", choices=["bcr", "tcr"], default="bcr")
    r.add_argument("-o", "--output_format", action="append", choices=["airr", "parquet"])
    r.add_argument("--umi_pattern")
    r.add_argument("--umi_length", type=int)
    r.add_argument("-m", "--merge", action="store_true")
    r.add_argument("--merge_kwargs", type=parse_dict, default={})
    r.add_argument("--interleaved_fastq", action="store_true")
    r.add_argument("--copy-inputs-to-project", action=argparse.BooleanOptionalAction, default=True)
    r.add_argument("--verbose", action=argparse.BooleanOptionalAction, default=True)
    r.add_argument("--debug", action="store_true")
    b = sub.add_parser("build_germline_database")
    b.add_argument("name")
    b.add_argument("-f", "--fasta", action="append", default=[])
    b.add_argument("-c", "--constant", action="append", default=[])
    b.add_argument("-j", "--json", action="append", default=[])
    b.add_argument("-r", "--receptor", choices=["bcr", "tcr"], default="bcr")
    b.add_argument("-l", "--location")
    b.add_argument("--no-species", dest="keep_species", action="store_false")
    b.add_argument("--overwrite", action="store_true")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    from pyspark.sql import SparkSession

    from cloneweave import api

    spark = SparkSession.builder.appName("cloneweave").getOrCreate()
    if a.command == "run":
        api.run(spark, a.input_path, a.project_path, a.germline_database, a.receptor, tuple(a.output_format or ["airr"]), a.umi_pattern, a.umi_length, a.merge, typed(a.merge_kwargs), a.interleaved_fastq, copy_inputs_to_project=a.copy_inputs_to_project, verbose=a.verbose, debug=a.debug, germline_location=a.germline_location)
    else:
        api.gl.build_germline_database(spark, a.name, a.fasta, a.constant, a.json, a.receptor, location=a.location, keep_species=a.keep_species, overwrite=a.overwrite)


if __name__ == "__main__":
    main()
