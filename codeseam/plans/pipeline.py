"""Whole runs: scan -> detect -> findings -> deduplicate -> enrich -> score; packages; model batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batching, dedup, enrich, findings, patterns, stats
from ..sources import detectors, manifests
from ..sources import files as scans
from . import analyzers


def detect(files: DataFrame, rules: list[str] | None = None, disabled: list[str] = ()) -> DataFrame:
    """Detector rows of all files, each analysed once; rules: names to keep (all if None), disabled: names to leave out."""
    return detectors.detect(files, rules, disabled)


def analyse(spark: SparkSession, root: str, rules: list[str] | None = None, disabled: list[str] = (), **options) -> dict[str, DataFrame]:
    """A directory's files, findings with a running number in the order of files and lines, and what follows from them."""
    files = scans.scan(spark, root, **options)
    return of_files(files, rules, disabled)


def of_files(files: DataFrame, rules: list[str] | None = None, disabled: list[str] = ()) -> dict[str, DataFrame]:
    raw = findings.from_static(analyzers.analyse(files, rules, disabled)).withColumns({"confidence": F.lit(1.0), "detected_at": F.lit(None).cast("timestamp_ntz")})
    f = findings.numbered(raw, ["file_path", "line_start", "rule_id", "message"])
    return {"files": files, "findings": f, **summarise(f)}


def analyse_paths(spark: SparkSession, roots: list[str], **options) -> dict[str, DataFrame]:
    """Selected files and directories as one run; a file reached twice counts once."""
    return of_files(scans.scan_paths(spark, roots, **options))


def summarise(f: DataFrame, tolerance: int = 5) -> dict[str, DataFrame]:
    groups = dedup.leader_groups(f, tolerance)
    merged = dedup.merged(f, groups)
    return {"groups": groups, "merged": merged, "enriched": enrich.enrich(merged), "severity": stats.by_severity(merged), "risk": stats.risk(merged), "quality": stats.quality(merged)}


def collect(*sources: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Findings of several sources, and any of the caller's own, as one collection with a running number."""
    frames = [*sources, *([custom] if custom is not None else [])]
    both = findings.unite(*(f.drop("ingest_seq").withColumn("source_no", F.lit(k)) for k, f in enumerate(frames)))
    return findings.numbered(both, ["source_no", "file_path", "line_start", "rule_id", "message"]).drop("source_no")


def dependencies(spark: SparkSession, root: str, advisories: DataFrame | None = None) -> dict[str, DataFrame]:
    """The manifests below a directory, their packages, and the packages' advisories where a dump is given."""
    files = manifests.discover(scans.scan(spark, root, ignored_dirs=tuple(manifests.SKIPPED_DIRS)))
    packages = manifests.packages(files)
    out = {"manifests": files, "packages": packages.where("error is null"), "errors": packages.where("error is not null")}
    if advisories is not None:
        out["advisories"] = manifests.advisories_for(out["packages"], manifests.advisories(advisories))
    return out


def model_patterns(files: DataFrame, analyser, max_tokens: int = 8000, exclude: list[str] = (), attempts: int = 3) -> DataFrame:
    """Patterns that a model (any function from a prompt to a response) finds in files: snippets, batches in order of
    path and line, prompts, responses, rows. Prompts that fail leave no pattern."""
    kept = files
    for glob in exclude:
        from ..functions.text import glob_regex

        kept = kept.where(~F.col("path").rlike(glob_regex(glob)))
    cut = findings.numbered(batching.snippets(kept, max_tokens, chunk_large_files=False, min_tokens=1), ["path", "start_line"], "seq")
    batched = cut.join(batching.next_fit(cut, "seq", "tokens", max_tokens), "seq")
    prompts = batching.prompt(batched.select("batch_id", "seq", F.col("path").alias("role"), "text"), "batch_id", "seq")
    return patterns.parse_responses(batching.analysed(prompts, analyser, attempts=attempts).where("error is null"))


def flagship(f: DataFrame, tolerance: int = 5) -> DataFrame:
    """Normalised findings -> leader groups -> merged -> debt and impact -> totals per type and severity."""
    merged = dedup.merged(f, dedup.leader_groups(f, tolerance))
    e = merged.select("finding_type", "severity", "group_size", enrich.debt(False).alias("debt"), enrich.business_impact().alias("business"))
    return e.groupBy("finding_type", "severity").agg(F.count("*").alias("n"), F.sum("group_size").alias("raw"), F.round(F.sum("debt"), 2).alias("debt"), F.count_if(F.col("business") == "high").alias("urgent"))
