"""Packages, licences and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_wins(packages: DataFrame, *ties: str) -> DataFrame:
    """Of a package that a manifest names repeatedly, the last mention; of several at one position the first by ties (columns
    that tell all rows apart), without which any may stand."""
    w = W.partitionBy("manifest", "package").orderBy(F.desc("position"), *ties)
    return packages.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    keys = advisories.select("package").distinct().withColumn("hit", F.lit(True))
    return packages.join(keys, "package", "left").select(*packages.columns, F.coalesce("hit", F.lit(False)).alias("has_vulnerabilities"))


def with_metadata(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """New field if it isn't empty, else the old one."""
    r = registry.select("package", F.col("licence").alias("new_licence"))
    return packages.join(r, "package", "left").select("manifest", "position", "package", F.coalesce(F.nullif("new_licence", F.lit("")), "licence").alias("licence"))


def advisories_of(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages with each of their advisories."""
    return packages.join(advisories, "package")


def manifest_stats(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    p = vulnerable(packages, advisories)
    return p.groupBy("manifest").agg(F.count("*").alias("total"), F.count_if(~F.col("dev") & ~F.col("optional")).alias("prod"), F.count_if("dev").alias("dev"), F.count_if("optional").alias("optional"), F.count_if("has_vulnerabilities").alias("vulnerable"), F.countDistinct("licence").alias("licences"))


def licence_distribution(packages: DataFrame) -> DataFrame:
    return packages.where("licence is not null").groupBy("licence").agg(F.count("*").alias("n"), F.countDistinct("package").alias("packages"))


def unlicensed(packages: DataFrame) -> DataFrame:
    return packages.agg(F.count_if(F.coalesce("licence", F.lit("")) == "").alias("unlicensed"), F.count("*").alias("total"))


def licence_names(packages: DataFrame) -> DataFrame:
    """licence, package: each package of a licence once; lists of names are made where they are shown."""
    return packages.where("licence is not null").select("licence", "package").distinct()


def graph(packages: DataFrame) -> DataFrame:
    """Edges manifest -> package for display."""
    return packages.select(F.concat(F.lit("manifest:"), F.col("manifest").cast("string")).alias("source"), F.concat(F.lit("package:"), F.col("package").cast("string")).alias("target")).distinct()


def closure(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Reachable (source, target) pairs, by doubling until nothing new is found; each round is checkpointed, which needs
    a checkpoint folder. More rounds than allowed is an error, never a part of the result."""
    seen = edges.select("source", "target").distinct().checkpoint()
    n = seen.count()
    for _ in range(rounds):
        more = seen.alias("a").join(seen.alias("b"), F.col("a.target") == F.col("b.source")).select(F.col("a.source"), F.col("b.target"))
        seen = seen.union(more).distinct().checkpoint()
        m = seen.count()
        if m == n:
            return seen
        n = m
    raise RuntimeError(f"edges reach further than {rounds} rounds")


def out_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source is one of nodes (column node)."""
    return edges.join(nodes.select(F.col("node").alias("source")).distinct().hint("merge"), "source", "left_semi")  # nodes may be many: not by the driver


def in_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("target")).distinct().hint("merge"), "target", "left_semi").select("source", "target")


def report_rows(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Rows of the dependency table: type, optional flag and whether there are advisories."""
    return vulnerable(packages, advisories).select("manifest", "position", "package_manager", "package", "version", F.coalesce("licence", F.lit("Unknown")).alias("licence"), F.when(F.col("dev"), "development").otherwise("production").alias("type"), F.when(F.col("optional"), "Yes").otherwise("No").alias("optional"), F.when(F.col("has_vulnerabilities"), "Yes").otherwise("No").alias("vulnerable"))


def direct_tree(packages: DataFrame) -> DataFrame:
    """manifest -> its packages, distinct and in order."""
    return packages.groupBy("manifest").agg(F.array_sort(F.collect_set("package")).alias("packages"))


def _package_objects() -> Column:
    return F.struct(F.col("package").cast("string").alias("name"), F.col("version").cast("string").alias("version"), F.coalesce("licence", F.lit("Unknown")).alias("licence"), F.col("dev").alias("dev"), F.col("optional").alias("optional"))


def manifest_documents(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """One document for each manifest: its statistics and its packages as JSON, in order of mention."""
    p = vulnerable(packages, advisories)
    objects = F.transform(F.array_sort(F.collect_list(F.struct("position", _package_objects().alias("p")))), lambda x: x["p"])
    return p.groupBy("manifest").agg(
        F.count("*").alias("total_dependencies"), F.count_if(~F.col("dev")).alias("production_dependencies"), F.count_if("dev").alias("dev_dependencies"),
        F.count_if("optional").alias("optional_dependencies"), F.count_if("has_vulnerabilities").alias("vulnerabilities"), F.countDistinct("licence").alias("unique_licenses"), F.to_json(objects).alias("dependencies"),
    )


def manifest_sections(packages: DataFrame) -> DataFrame:
    """The Markdown section of each manifest: a table of its packages."""
    kind = F.concat(F.when(F.col("dev"), "dev").otherwise("prod"), F.when(F.col("optional"), " (optional)").otherwise(""))
    row = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("package").cast("string")), F.col("version").cast("string"), kind, F.concat(F.coalesce("licence", F.lit("Unknown")), F.lit(" |")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("row")))), lambda x: x["row"]), "\n")
    head = "| Package | Version | Type | License |\n|---------|---------|------|---------|\n"
    return packages.groupBy("manifest").agg(F.concat(F.lit("### "), F.first("manifest").cast("string"), F.lit("\n\n" + head), rows).alias("section"))


def report_summary(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """(part, name, n): totals, advisories by severity, packages by licence, manifests by manager."""
    hit = advisories_of(packages.select("manifest", "package"), advisories)
    total = packages.agg(F.countDistinct("manifest").alias("total_files"), F.count("*").alias("total_dependencies"), F.countDistinct("licence").alias("total_license_types"))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in total.columns))
    parts = [
        total.select(F.explode(pairs).alias("p")).select(F.lit("total").alias("part"), "p.name", "p.n"),
        hit.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit("total_vulnerabilities").alias("name"), "n"),
        hit.groupBy("severity").agg(F.count("*").alias("n")).select(F.lit("severity").alias("part"), F.col("severity").alias("name"), "n"),
        packages.where("licence is not null").groupBy("licence").agg(F.count("*").alias("n")).select(F.lit("licence").alias("part"), F.col("licence").alias("name"), "n"),
        packages.groupBy("package_manager").agg(F.countDistinct("manifest").alias("n")).select(F.lit("manager").alias("part"), F.col("package_manager").alias("name"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def only(view: str, packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """One side of a dependency report: vulnerabilities or licenses."""
    if view == "vulnerabilities":
        return advisories_of(packages.select("manifest", "package"), advisories)
    if view == "licenses":
        return licence_distribution(packages)
    raise ValueError(f"unknown view {view!r}")
