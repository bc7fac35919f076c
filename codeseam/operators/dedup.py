"""Content ids, near-duplicate pairs, greedy leader groups and merging of findings."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .likeness import Leaders, containing
from ..schemas import DEPENDENCY_TYPES, PERFORMANCE_TYPES, QUALITY_TYPES, SECURITY_TYPES, SEVERITIES, STYLE_TYPES, complete, severity_ordinal, type_group


def content_id() -> Column:
    """First 16 hex digits of SHA-256 over type:file:line:title:rule; absent parts read None."""
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("finding_type", "file_path", "line_start", "title", "rule_id"))
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def _either_way(a: Column, b: Column) -> Column:
    """Whether one text contains the other; empty ones contain and are in nothing."""
    a, b = F.lower(a), F.lower(b)
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def _scopes(findings: DataFrame) -> list[Column]:
    """function_name and class_name, null where findings have none."""
    return [(F.col(c) if c in findings.columns else F.lit(None).cast("string")).alias(c) for c in ("function_name", "class_name")]


def similar_pairs(findings: DataFrame, tolerance: int = 5) -> DataFrame:
    """(a, b) by ingest_seq, a < b: same file, compatible types, near places, like content.

    Places are near if their lines are; where one has no line, if function or class are the same, also if neither
    has one. The equi-key is (file, type group); findings with lines are also keyed by blocks of lines, each row
    meeting its own and the neighbouring ones, so that a hot file isn't compared with itself as a whole; findings
    without lines meet by rule and by rare q-grams."""
    f = findings.select("ingest_seq", "file_path", type_group("finding_type").alias("grp"), "line_start", "rule_id", "title", "message", *_scopes(findings))
    step = max(1, tolerance)
    lined = f.where("line_start is not null").withColumn("block", F.floor(F.col("line_start") / step))
    blocks = F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)
    x, y = lined.withColumn("meet", F.explode(blocks)).alias("x"), lined.alias("y")
    same = (F.col("x.file_path") == F.col("y.file_path")) & (F.col("x.grp") == F.col("y.grp"))
    same_rule = (F.col("x.rule_id") == F.col("y.rule_id")) & (F.length("x.rule_id") > 0)
    like = F.lit(False)
    for part in (same_rule, _either_way(F.col("x.title"), F.col("y.title")), _either_way(F.col("x.message"), F.col("y.message"))):
        like = like | F.coalesce(part, F.lit(False))
    near = (F.col("x.meet") == F.col("y.block")) & (F.abs(F.col("x.line_start") - F.col("y.line_start")) <= tolerance)
    pairs = x.join(y, same & near & like & (F.col("x.ingest_seq") < F.col("y.ingest_seq"))).select(F.col("x.ingest_seq").alias("a"), F.col("y.ingest_seq").alias("b"))
    # without a line on one side at least: pairs by rule, and texts that hold each other by their q-grams
    loose_files = f.where("line_start is null").select("file_path", "grp").distinct()
    g = f.join(loose_files, ["file_path", "grp"], "left_semi")
    scope = ["function_name", "class_name"]
    lined = F.col("line_start").isNotNull().alias("lined")
    ends = g.select("ingest_seq", lined, *scope)
    ruled = g.where("length(rule_id) > 0").select("file_path", "grp", "rule_id", F.col("ingest_seq").alias("n"), lined)
    by_rule = ruled.where("not lined").select("file_path", "grp", "rule_id", F.col("n").alias("a")).join(ruled.select("file_path", "grp", "rule_id", F.col("n").alias("b")), ["file_path", "grp", "rule_id"]).where("a <> b").select("a", "b")
    by_text = [containing(g.select("file_path", "grp", F.col("ingest_seq").alias("n"), F.lower(c).alias("text")), ["file_path", "grp"]).select(F.col("inner").alias("a"), F.col("outer").alias("b")) for c in ("title", "message")]
    drawn = reduce(DataFrame.union, [by_rule, *by_text]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = (ends.select(*(F.col(c).alias(f"{c}_{k}") for c in ends.columns)) for k in "ab")
    near_scope = F.col("function_name_a").eqNullSafe(F.col("function_name_b")) | F.col("class_name_a").eqNullSafe(F.col("class_name_b"))
    loose = drawn.join(x, F.col("a") == F.col("ingest_seq_a")).join(y, F.col("b") == F.col("ingest_seq_b")).where(near_scope & ~(F.col("lined_a") & F.col("lined_b"))).select("a", "b")
    return pairs.union(loose)


def leader_groups(findings: DataFrame, tolerance: int = 5) -> DataFrame:
    """ingest_seq, leader: each finding, in arrival order within its file, joins the first leader it resembles, else leads.

    Order-dependent and not transitive, so a fold in arrival order. Only findings of one (file, type group) can
    resemble each other, so that is the partition; rows stream in order. Leaders are held by line and, for findings
    without one, in an index of rare q-grams by function and by class, so that a manifest's findings aren't compared
    with all before them."""
    rows = findings.select("file_path", type_group("finding_type").alias("grp"), "ingest_seq", "line_start", "rule_id", "title", "message", *_scopes(findings))
    rows = rows.repartition("file_path", "grp").sortWithinPartitions("file_path", "grp", "ingest_seq")

    def alike(x, rule, title, message):
        return (rule and rule == x[2]) or (title and x[3] and (title in x[3] or x[3] in title)) or (message and x[4] and (message in x[4] or x[4] in message))

    def run(batches):
        at = None
        for batch in batches:
            seqs, heads = [], []
            for file, grp, seq, line, rule, title, message, *scope in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if (file, grp) != at:  # leaders by line; by function and by class: those without a line, and all
                    at, by_line, loose, every, order = (file, grp), {}, {}, {}, 0
                texts = (title or "").lower(), (message or "").lower()
                near = (x for k in range(line - tolerance, line + tolerance + 1) for x in by_line.get(k, ())) if line is not None else ()
                found = [x[:2] for x in near if alike(x, rule, *texts)]
                for k in enumerate(scope):
                    index = (every if line is None else loose).get(k)
                    found.append(index.first(rule, texts) if index else None)
                head = min((h for h in found if h), default=None)
                if head is None:
                    head = (order, seq)
                    if line is not None:
                        by_line.setdefault(line, []).append((order, seq, rule, *texts))
                    for held in (every,) if line is not None else (every, loose):
                        for k in enumerate(scope):
                            held.setdefault(k, Leaders()).add(head, rule, texts)
                    order += 1
                seqs.append(seq)
                heads.append(head[1])
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(heads, pa.int64())], ["ingest_seq", "leader"])

    return rows.mapInArrow(run, "ingest_seq long, leader long")


def _joined(acc: Column, x: Column) -> Column:
    """Texts joined by a bar; an empty one, or one that all so far already is, adds nothing."""
    return F.when((x == "") | (x == acc), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(" | "), x))


_FIRST = ("title", "message", "rule_id", "affected_code", "fix_recommendation")
_OWN = ("finding_type", "file_path", "line_start", "line_end", "column_start", "column_end", "function_name", "class_name", "source", "impact", "effort_to_fix", "severity")


def merged(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """One finding for each group: the primary (severity, then confidence, then arrival) with what the others add.

    Members with the primary's content id aren't folded. The others fold in arrival order: descriptions and
    suggestions are joined, tools listed, tags and related findings united (sorted), the largest confidence and the
    earliest time kept, and of other texts the first that isn't empty; place, type, impact and effort are the
    primary's. merged_from names sources, tools and rules of all that were folded, merged_findings the members' ids."""
    f = complete(findings).join(groups, "ingest_seq").withColumn("id", content_id())
    columns = ["id", *_OWN, *_FIRST, "confidence", "tool_name", "description", "suggestion", "tags", "related_findings", "detected_at"]
    rank = F.struct((-severity_ordinal()).alias("s"), (-F.col("confidence")).alias("c"), F.col("ingest_seq").alias("q"))
    member = F.struct(F.col("ingest_seq").alias("q"), *columns)
    g = f.groupBy("leader").agg(F.min_by(member, rank).alias("p"), F.array_sort(F.collect_list(member)).alias("m"))
    p = F.col("p")
    folded = g.withColumn("o", F.filter("m", lambda x: x["id"] != p["id"]))
    o = F.col("o")
    every = F.concat(F.array(p), o)

    def first(name):
        return F.get(F.filter(F.transform(every, lambda x: x[name]), lambda v: F.length(v) > 0), F.lit(0))

    def united(name):
        return F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda x: x[name]))))

    empty = {n: F.coalesce(first(n), F.lit("")) if n in ("title", "message", "fix_recommendation") else first(n) for n in _FIRST}
    return folded.select(
        "leader", F.size("m").cast("long").alias("group_size"), p["q"].alias("primary"), p["id"].alias("id"), *(p[n].alias(n) for n in _OWN), *(v.alias(n) for n, v in empty.items()),
        F.aggregate(o, p["confidence"], lambda a, x: F.greatest(a, x["confidence"])).alias("confidence"), F.aggregate(o, p["detected_at"], lambda a, x: F.least(a, x["detected_at"])).alias("detected_at"),
        F.array_join(F.transform(every, lambda x: x["tool_name"]), ", ").alias("tool_name"), F.aggregate(o, p["description"], lambda a, x: _joined(a, x["description"])).alias("description"),
        F.aggregate(o, p["suggestion"], lambda a, x: _joined(a, x["suggestion"])).alias("suggestion"), united("tags").alias("tags"), united("related_findings").alias("related_findings"),
        F.transform(every, lambda x: F.struct(x["source"].alias("source"), x["tool_name"].alias("tool"), x["rule_id"].alias("rule_id"))).alias("merged_from"),
        F.transform("m", lambda x: x["id"]).alias("merged_findings"), (F.size("m") > 1).alias("is_merged"),
    )


#: Groups of types that count as compatible where reasons are given: wider than those that let findings meet.
REASON_GROUPS = {"security": SECURITY_TYPES, "quality": QUALITY_TYPES, "style": STYLE_TYPES, "dependency": DEPENDENCY_TYPES, "performance": PERFORMANCE_TYPES}


def within_one_group(types: Column) -> Column:
    """Whether an array of types is a subset of one of the groups."""
    out = F.size(F.array_distinct(types)) <= 1
    for names in REASON_GROUPS.values():
        out = out | (F.size(F.array_except(types, F.array(*map(F.lit, names)))) == 0)
    return out


def merge_reasons(findings: DataFrame, groups: DataFrame, tolerance: int = 5) -> DataFrame:
    """Why the members of a group of two and more were joined."""
    f = complete(findings).join(groups, "ingest_seq")
    place = F.struct("line_start", "column_start")
    g = f.groupBy("leader").agg(
        F.count("*").alias("n"), F.size(F.collect_set(place)).alias("places"), F.countDistinct("line_start").alias("lines"), F.countDistinct(F.nullif("rule_id", F.lit(""))).alias("rules"),
        F.collect_set("finding_type").alias("types"), F.collect_set(F.lower(F.nullif("title", F.lit("")))).alias("t"), F.collect_set(F.lower(F.nullif("message", F.lit("")))).alias("m"),
    ).where("n > 1")

    def inside(c):
        return F.exists(c, lambda a: F.exists(c, lambda b: (a != b) & F.contains(b, a)))

    reasons = F.array_compact(F.array(
        F.when(F.col("places") == 1, "exact_location_match").when(F.col("lines") <= tolerance, "nearby_location_match"), F.when(F.col("rules") == 1, "same_rule_id"),
        F.when(F.size("types") == 1, "same_finding_type").when(within_one_group(F.col("types")), "compatible_finding_types"),
        F.when(inside("t"), "similar_titles"), F.when(inside("m"), "similar_messages"),
    ))
    return g.select("leader", F.col("n").alias("group_size"), F.array_join(F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("similarity_match"))), ",").alias("reasons"))


def deduplicate(findings: DataFrame, tolerance: int = 5) -> DataFrame:
    """Findings merged by their leader groups, in one call."""
    return merged(findings, leader_groups(findings, tolerance))


def dedup_stats(groups: DataFrame) -> DataFrame:
    """before, after (groups), merged groups, kept alone, reduction in percent."""
    g = groups.groupBy("leader").count()
    return g.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("before_count"), F.count("*").alias("total_groups"), F.count_if(F.col("count") > 1).alias("merged_count"), F.count_if(F.col("count") == 1).alias("kept_count")).withColumn("reduction_percent", F.when(F.col("before_count") > 0, F.round(100.0 * (F.col("before_count") - F.col("total_groups")) / F.col("before_count"), 2)).otherwise(0.0))


def duplicates(groups: DataFrame) -> DataFrame:
    """ingest_seq, duplicate_of for members that aren't the leader."""
    return groups.where("ingest_seq <> leader").select("ingest_seq", F.col("leader").alias("duplicate_of"))


def first_per(findings: DataFrame, keys: list[str], order: str = "ingest_seq") -> DataFrame:
    return findings.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def top_severity(column: str = "severity") -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(severity_ordinal(column)))
