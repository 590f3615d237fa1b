"""The commands: init, query, export, analyze, calibrate, study, findings and version. ``python -m simlattice.cli COMMAND --repo PATH``"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import calibrate, deltas
from .plans.analysis import Analysis, by_language
from .runtime import cut
from .sinks import documents, store, studies
from .sources import files, tables


#: Fewer functions than this tell nothing about a threshold.
LEAST_ELIGIBLE = 10


def _session() -> SparkSession:
    return SparkSession.builder.appName("simlattice").getOrCreate()


def _stored(spark: SparkSession, index: str) -> Analysis:
    """An analysis whose results are the stored ones."""
    read = lambda name: tables.table(spark, index, name)
    a = Analysis(read("functions"))
    a.__dict__ |= {"fns": read("functions"), "members": read("cluster_members").drop("lang"), "clusters": read("clusters").drop("ordinal", "stage", "lang"), "near_misses": read("near_misses").drop("lang")}
    return a


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="simlattice", description="Finds recurring shapes, and near-misses around them, in source code.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("init", "analyse a source tree and store its index"), ("export", "print the index as JSON"), ("analyze", "write the report"), ("calibrate", "compare thresholds")):
        c = sub.add_parser(name, help=help_)
        c.add_argument("--repo", required=True)
        c.add_argument("--index", help="the index's folder; by default .simlattice in the repository")
        if name == "init":
            c.add_argument("--records", help="JSON files of a Java parser")
            c.add_argument("--dry-run", action="store_true", help="analyse, but store nothing")
        elif name == "export":
            c.add_argument("--min-score", type=float, default=0.0)
        elif name == "calibrate":
            c.add_argument("--rounds", type=int, default=20)
            c.add_argument("--output")
    q = sub.add_parser("query", help="ask the index").add_subparsers(dest="what", required=True)
    for name in ("outlier", "cluster"):
        c = q.add_parser(name)
        c.add_argument("--repo", required=True)
        c.add_argument("--index")
        c.add_argument("--format", choices=("text", "json"), default="text")
        if name == "cluster":
            c.add_argument("shape", help="the shape hash, in full")
    sub.add_parser("version")
    sub.add_parser("study", help="write the documents of a study over releases").add_argument("folder", help="with releases.csv and outliers-<tag>.json")
    sub.add_parser("findings", help="write the matrix of findings as Markdown and as a page").add_argument("file", help="JSON")
    args = p.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    spark = _session()
    index = getattr(args, "index", None) or os.path.join(getattr(args, "repo", ""), ".simlattice")
    if args.command == "init":
        fns = files.read_tree(spark, args.repo, args.records)
        analyses = by_language(fns)
        if args.dry_run:
            for lang, a in analyses.items():
                print(f"{lang}: {a.fns.count()} functions, {a.clusters.count()} clusters, {a.near_misses.select('fn_id').distinct().count()} near misses")
            return 0
        store.write_index(analyses, index)
        a = _stored(spark, index)
        documents.save(documents.outlier_document(a, args.repo), os.path.join(index, "outliers.md"))
        documents.save(documents.html_report(a, args.repo), os.path.join(index, "report.html"))
    elif args.command == "analyze":
        documents.save(documents.html_report(_stored(spark, index), args.repo), os.path.join(index, "report.html"))
    elif args.command == "export":
        for line in documents.json_lines(_stored(spark, index).export(repo=args.repo, commit=tables.head_commit(args.repo), min_score=args.min_score)):
            print(line)
    elif args.command == "calibrate":
        a = Analysis(files.read_tree(spark, args.repo).where("lang = 'golang'"))
        eligible = calibrate.eligible_count(a.fns).first()["eligible"]
        if eligible < LEAST_ELIGIBLE:
            print(f"{eligible} eligible functions are too few to calibrate with; {LEAST_ELIGIBLE} are needed", file=sys.stderr)
            return 1
        points = cut(a.calibrate(rounds=args.rounds))
        by_sequence = cut(calibrate.sequence_sweep(a.fns, a.cfg, rounds=args.rounds))
        for line in studies.calibration_text(points, calibrate.knee(points), by_sequence, eligible, args.rounds):
            print(line)
        store.write_calibration(points, args.output or os.path.join(index, "calibration.csv"))
    elif args.command == "study":
        rel = tables.csv(spark, os.path.join(args.folder, "releases.csv"), "tag string, idx long, clusters long, functions long")
        snaps = tables.snapshots(spark, args.folder, rel)
        sizes = snaps.where("cluster <> ''").groupBy("tag", "idx", F.col("cluster").alias("shape_hash")).agg(F.count("*").alias("size"))
        found, title = studies.study_tables(snaps, rel, sizes), os.path.basename(os.path.abspath(args.folder))
        studies.write_study(found, os.path.join(args.folder, "tables"))
        documents.save(studies.study_report(found, title), os.path.join(args.folder, "report.md"))
        documents.save(studies.analysis_report(found, title), os.path.join(args.folder, "analysis.md"))
    elif args.command == "findings":
        found, base = tables.findings(spark, args.file), os.path.splitext(args.file)[0]
        documents.save(documents.security_markdown(found, os.path.basename(base)), base + ".md")
        documents.save(studies.findings_page(found, os.path.basename(base)), base + ".html")
    elif args.what == "outlier":
        rows = _stored(spark, index).outliers()
        for line in documents.json_lines(rows) if args.format == "json" else documents.outlier_text(rows):
            print(line)
    else:
        a = _stored(spark, index)
        rows = deltas.cluster_shape(args.shape, a.clusters, a.members, a.fns)
        if rows.isEmpty():
            print(f"no cluster has the shape {args.shape}", file=sys.stderr)
            return 1
        for line in documents.json_lines(rows) if args.format == "json" else documents.cluster_text(rows.first()):
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
