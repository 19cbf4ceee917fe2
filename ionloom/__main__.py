"""Command line: query a run, search runs with a library, build a library, write templates."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _query(spark: SparkSession, a: argparse.Namespace) -> None:
    from ionloom.api import Run
    from ionloom.functions.ranges import tolerance_from_json
    from ionloom.sources.sinks import write_json_array, write_ndjson
    from ionloom.sources.text_libraries import read_elution_groups

    with open(a.tolerance) as f:
        t = tolerance_from_json(json.load(f))
    run = Run.open(spark, a.index)
    groups = read_elution_groups(spark, a.groups).withColumn("fragments", F.transform("fragments", lambda x: F.struct(x.label.alias("label"), x.mz.alias("mz"))))
    out = {"point": run.query_point, "spectrum": run.query_spectrum, "stats": run.query_mz_mobility, "chromatogram": run.query_chromatogram}[a.aggregator](groups, t)
    write_ndjson(out, a.output) if a.format == "ndjson" else write_json_array(out, a.output, a.format == "pretty")


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    from ionloom.plans.search import Settings, search
    from ionloom.sources.peaks import read_index
    from ionloom.sources.sinks import Report, write_calibration, write_results

    report = Report()
    peaks, cycles, windows, _ = read_index(spark, a.index)
    library = spark.read.parquet(a.library)
    with report.phase("search"):
        results, cal = search(library, peaks.withColumnsRenamed({"mobility_ook0": "mobility", "cycle_index": "cycle"}), cycles, windows, Settings(decoys=a.decoys, max_q=a.max_q), report.values)
        write_results(results, f"{a.output}/results", a.max_q)
    if isinstance(cal, dict):
        for k, c in enumerate(cal[run_id] for run_id in sorted(cal)):
            write_calibration(c, f"{a.output}/calibration_{k}.json")
    else:
        write_calibration(cal, f"{a.output}/calibration.json")
    report.write(f"{a.output}/report.json")


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    from ionloom.plans.library import Build, build, entries, forms, predicted
    from ionloom.sources.native import read_fasta, read_peptide_list

    settings = Build(missed=a.missed, decoys=a.decoys)
    if a.fasta:
        out = build(read_fasta(spark, a.fasta), settings)
    else:
        out = entries(predicted(forms(read_peptide_list(spark, a.peptides).select(F.col("peptide").alias("plain")), settings)), settings)
    out.write.mode("overwrite").parquet(a.output)


def _show(spark: SparkSession, a: argparse.Namespace) -> None:
    from ionloom.sources.registry import read_library

    read_library(spark, a.library).show(a.rows, truncate=80)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ionloom")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="extract elution groups from a run")
    for name in ("index", "groups", "tolerance", "output"):
        q.add_argument(f"--{name}", required=True)
    q.add_argument("--aggregator", choices=["point", "spectrum", "stats", "chromatogram"], default="chromatogram")
    q.add_argument("--format", choices=["json", "pretty", "ndjson"], default="ndjson")
    s = sub.add_parser("search", help="search runs with a library")
    for name in ("index", "library", "output"):
        s.add_argument(f"--{name}", required=True)
    s.add_argument("--decoys", choices=["never", "if_missing", "force"], default="if_missing")
    s.add_argument("--max-q", dest="max_q", type=float, default=0.5)
    b = sub.add_parser("build-library", help="build a library from proteins or peptides")
    source = b.add_mutually_exclusive_group(required=True)
    source.add_argument("--fasta")
    source.add_argument("--peptides")
    b.add_argument("--output", required=True)
    b.add_argument("--missed", type=int, default=1)
    b.add_argument("--decoys", choices=["none", "reverse", "mutate"], default="reverse")
    d = sub.add_parser("show-library", help="print entries of a library of any kind")
    d.add_argument("library")
    d.add_argument("--rows", type=int, default=20)
    w = sub.add_parser("write-template", help="write example query files")
    w.add_argument("folder")
    a = p.parse_args(argv)
    if a.command == "write-template":
        from ionloom.sources.text_libraries import write_elution_group_templates

        print("\n".join(write_elution_group_templates(a.folder)))
        return
    from ionloom.runtime import session

    {"query": _query, "search": _search, "build-library": _build, "show-library": _show}[a.command](SparkSession.getActiveSession() or session("local[*]"), a)


if __name__ == "__main__":
    main()
