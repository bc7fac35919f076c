"""python -m codeseam: analyse a directory, list its dependencies, show or write settings."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from . import config as settings


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("codeseam").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeseam", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--dry-run", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyse", help="findings of a directory or file")
    a.add_argument("path")
    a.add_argument("--format", choices=settings.FORMS)
    a.add_argument("--output")
    a.add_argument("--exclude", action="append", default=[])
    a.add_argument("--no-tests", action="store_true")
    a.add_argument("--language", action="append", default=[])
    a.add_argument("--export", action="append", default=[], metavar="FORMAT")
    a.add_argument("--export-to", default="reports")
    d = commands.add_parser("dependencies", help="packages of a directory's manifests")
    d.add_argument("path")
    d.add_argument("--advisories", help="a file or folder of advisories, one JSON document a line")
    d.add_argument("--view", choices=("all", "vulnerabilities", "licenses"), default="all")
    commands.add_parser("config-info", help="the settings in force")
    i = commands.add_parser("init-config", help="writes a file of settings")
    i.add_argument("--output", default="codeseam.yaml")
    commands.add_parser("version")
    return p


def located(path: str) -> str:
    """A path as Spark finds it, whatever its own working folder is."""
    return path if "://" in path else str(Path(path).resolve())


def analyse(o, config: settings.Config) -> int:
    from .operators.findings import of_language
    from .plans import pipeline
    from .sinks import reports
    from .sources import files as scans

    spark = session()
    files = scans.scan(spark, located(o.path), max_bytes=config.analysis.max_file_size, include_tests=config.analysis.include_tests and not o.no_tests, exclude=[*config.analysis.exclude_patterns, *o.exclude])
    out = pipeline.of_files(of_language(files, o.language) if o.language else files)
    report = reports.engine_report(out, o.format or config.output_format)
    target = o.output or config.output_file
    if target:
        Path(target).write_text(report)
    else:
        print(report)
    for form, state in reports.export(out["findings"], located(o.export_to), o.export, o.dry_run or config.dry_run).items():
        print(f"{form}: {state}")
    return 0


def dependencies(o) -> int:
    from .plans import pipeline

    spark = session()
    out = pipeline.dependencies(spark, located(o.path), spark.read.text(located(o.advisories)).withColumnRenamed("value", "json") if o.advisories else None)
    if o.view == "all":
        out["packages"].groupBy("path", "manager").count().orderBy("path").show(truncate=False)
    if o.view != "licenses" and "advisories" in out:
        out["advisories"].select("path", "package", "version", "id", "severity").orderBy("path", "package").show(truncate=False)
    for r in out["errors"].collect():
        print(f"{r.path}: {r.error}", file=sys.stderr)
    return 1 if "advisories" in out and out["advisories"].limit(1).count() else 0


def main(argv: list[str] | None = None) -> int:
    o = arguments().parse_args(argv)
    if o.command == "version":
        try:
            print(version("codeseam"))
        except PackageNotFoundError:
            print("not installed")
        return 0
    if o.command == "init-config":
        if Path(o.output).exists():
            print(f"{o.output} exists", file=sys.stderr)
            return 1
        settings.save(settings.Config(), o.output)
        return 0
    config = settings.load(o.config)
    if o.command == "config-info":
        for k, v in asdict(config).items():
            print(f"{k}: {v}")
        return 0
    return analyse(o, config) if o.command == "analyse" else dependencies(o)


if __name__ == "__main__":
    sys.exit(main())
