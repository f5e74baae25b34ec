"""Scans from the command line: ``python -m siltstone scan TABLES``.

TABLES is a folder of Parquet tables named like the fields of ``plans.scan.Tables``; those that are there decide
which analyzers run. The session is the one that ``spark-submit`` or the environment gives. Exit code 1: a report is High or Critical."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import cache, report, scan
from siltstone.sources import packages as sources


def tables(spark: SparkSession, folder: str) -> scan.Tables:
    """The tables below a folder; only packages must be there."""
    found: dict[str, DataFrame] = {}
    for field in fields(scan.Tables):
        if field.name != "now":
            try:
                found[field.name] = spark.read.parquet(f"{folder.rstrip('/')}/{field.name}.parquet")
            except AnalysisException:
                if field.name == "packages":
                    raise
    return scan.Tables(**found)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siltstone", description="Risk reports of packages.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, about in (("scan", "scores of all packages"), ("check", "full reports"), ("gate", "which packages may be installed without asking")):
        one = commands.add_parser(name, help=about)
        one.add_argument("tables", help="a folder of Parquet tables")
        one.add_argument("--package", action="append", help="name or name@version; else all")
        one.add_argument("--compare", action="store_true", help="compare with older versions")
        one.add_argument("--deep", action="store_true", help="follow dependencies")
        one.add_argument("--ignore", action="append", help="a file of ignore rules")
        one.add_argument("--out", help="a folder for the result; else it is shown")
        if name == "scan":
            one.add_argument("--cache", help="a folder of cached reports")
            one.add_argument("--hours", type=float, default=24.0, help="how long a cached report counts")
        elif name == "check":
            one.add_argument("--format", choices=("text", "json", "sarif"), default="text")
        else:
            one.add_argument("--force", action="store_true", help="approve everything")
    of_cache = commands.add_parser("cache", help="clear or compact cached reports")
    of_cache.add_argument("action", choices=("clear", "prune"))
    of_cache.add_argument("folder")
    of_cache.add_argument("--hours", type=float, default=24.0)
    return top


def _chosen(spark: SparkSession, known: scan.Tables, specs: list[str] | None) -> scan.Tables:
    """The tables with only the packages that were named."""
    if not specs:
        return known
    wanted = sources.requested(spark.createDataFrame([(s,) for s in specs], "spec string")).withColumnsRenamed({"name": "package", "version": "wanted"})
    packages = known.packages.join(wanted, "package").where("wanted is null or wanted = version").drop("wanted").distinct()
    return scan.Tables(**{**known.__dict__, "packages": packages})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    now = F.current_timestamp()
    if args.command == "cache":
        if args.action == "clear":
            print("cleared" if cache.clear(spark, args.folder) else "there is no cache")
        else:
            cache.prune(spark, args.folder, now, int(args.hours * 3600))
        return 0
    known = _chosen(spark, tables(spark, args.tables), args.package)
    ignore = sources.ignore_rules(spark, args.ignore) if args.ignore else None
    names = [n for n in scan.REGISTRY if (args.compare or n != scan.COMPARE) and (args.deep or n != scan.DEEP)]
    found = scan.analyze(known, names).join(known.packages.select("package", "version").distinct(), ["package", "version"], "left_semi")
    found = found if ignore is None else report.ignored(found, ignore)
    if args.command == "check" and args.format == "sarif":
        pieces = report.sarif_run(found)
        if args.out:
            report.write_sarif(pieces, args.out)
        else:
            for row in pieces.orderBy(F.when(F.col("package").isNull(), F.col("pos")).otherwise(0), "package", "version", "pos").toLocalIterator():
                print(row["text"], end="")
        return report.exit_code(report.scores(known.packages, found)).first()["code"]
    if args.command == "check":
        full = report.reports(known.packages, found)
        result, scored = (report.terminal(full) if args.format == "text" else report.as_json(full)), full
    else:
        saved = cache.load(spark, args.cache) if args.command == "scan" and args.cache else None
        if saved is not None:
            saved = report.fresh(saved, now, int(args.hours * 3600))
            pending = report.pending(known.packages, saved)
            fresh = report.scores(pending, found.join(pending, ["package", "version"], "left_semi"))
            scored = fresh.unionByName(saved.join(known.packages, ["package", "version"], "left_semi").select(fresh.columns))
        else:
            fresh = scored = report.scores(known.packages, found)
        if args.command == "scan" and args.cache:
            cache.save(fresh, args.cache, now)
        result = report.gate(scored, args.force) if args.command == "gate" else scored
    if args.out:
        result.write.mode("errorifexists").parquet(args.out)
    else:
        for row in result.orderBy("package", "version").toLocalIterator():
            print(row[-1] if args.command == "check" else "\t".join(map(str, row)))
    return 0 if args.command == "gate" else report.exit_code(scored).first()["code"]


if __name__ == "__main__":
    sys.exit(main())
