"""Patterns that a model found: JSON objects from streamed text, responses to rows, filters, results to export."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds of patterns a response may name.
KINDS = [
    "singleton", "factory", "observer", "strategy", "command", "adapter", "decorator", "facade", "builder", "prototype", "abstract_factory", "bridge", "composite",
    "flyweight", "proxy", "chain_of_responsibility", "interpreter", "iterator", "mediator", "memento", "state", "template_method", "visitor",
    "god_object", "spaghetti_code", "magic_numbers", "dead_code", "duplicate_code", "long_parameter_list", "large_class", "feature_envy", "inappropriate_intimacy",
    "refused_bequest", "lazy_class", "data_class", "switch_statements", "temporary_field", "message_chains", "middle_man", "divergent_change", "shotgun_surgery",
    "parallel_inheritance", "comments", "long_method", "cyclomatic_complexity", "cognitive_complexity", "maintainability_index", "technical_debt",
    "security_vulnerability", "performance_issue",
]
#: Fields that every pattern must have, and those of each list of a response.
REQUIRED = {
    "pattern_type": "string", "confidence": "double", "file_path": "string", "line_start": "int", "line_end": "int", "description": "string", "evidence": "array<string>",
    "severity": "string", "impact": "string", "effort": "string",
}
LISTS = {"design_patterns": ("benefits", "use_cases", "related_patterns"), "anti_patterns": ("problems", "solutions", "refactoring_suggestions"), "code_quality_issues": ()}
CATEGORY = {"design_patterns": "design_pattern", "anti_patterns": "anti_pattern", "code_quality_issues": "quality_issue"}
EXPORT = ["pattern_type", "confidence", "file_path", "line_start", "line_end", "description", "severity", "impact", "effort", "category"]
_EXTRA = [x for names in LISTS.values() for x in names]


def objects_in(text: str) -> tuple[list[str], str]:
    """The complete JSON objects in a text, and the rest after the last one. A run of balanced braces that is no JSON is
    searched again from its second character on."""
    out, start = [], 0
    while (begin := text.find("{", start)) >= 0:
        depth = end = 0
        for k in range(begin, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if not depth:
                end = k + 1
                break
        if not end:
            break
        try:
            json.loads(text[begin:end])
        except ValueError:
            start = begin + 1
        else:
            out.append(text[begin:end])
            text, start = text[end:], 0
    return out, text


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(texts: pd.Series) -> pd.Series:
    """The complete JSON objects in each text, in order."""
    return texts.map(lambda t: objects_in(t or "")[0])


def unfenced(text: Column) -> Column:
    """A response without the fence that some put around JSON."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^\s*```json", ""), r"```\s*$", "")


def parse_responses(responses: DataFrame, key: str = "batch_id") -> DataFrame:
    """key, the required fields, the lists' own fields and category of each pattern of responses (key, response). Patterns
    of unknown kinds or without a required field are left out, as are responses that are no JSON."""
    fields = ", ".join(f"{n}:{t}" for n, t in REQUIRED.items())
    schema = ", ".join(f"{name} array<struct<{fields}{''.join(f',{x}:array<string>' for x in own)}>>" for name, own in LISTS.items())
    doc = F.from_json(unfenced(F.col("response")), schema)

    def rows(name):
        own = set(LISTS[name])
        none = F.array().cast("array<string>")
        return F.transform(
            F.coalesce(doc[name], F.array().cast(f"array<struct<{fields}{''.join(f',{x}:array<string>' for x in LISTS[name])}>>")),
            lambda p: F.struct(*(p[n].alias(n) for n in REQUIRED), *(F.coalesce(p[x], none).alias(x) if x in own else none.alias(x) for x in _EXTRA), F.lit(CATEGORY[name]).alias("category")),
        )

    found = responses.select(key, F.explode(F.concat(*(rows(n) for n in LISTS))).alias("p")).select(key, "p.*")
    for n in REQUIRED:
        found = found.where(F.col(n).isNotNull())
    return found.where(F.col("pattern_type").isin(KINDS))


def of_severity(patterns: DataFrame, severity: str) -> DataFrame:
    return patterns.where(F.col("severity") == severity)


def of_file(patterns: DataFrame, path: str) -> DataFrame:
    return patterns.where(F.col("file_path") == path)


def summary(patterns: DataFrame) -> DataFrame:
    """Counts of all, of each category and of each level; error counts as high, warning as medium, info as low."""
    levels = {"critical": "critical_issues", "error": "high_issues", "warning": "medium_issues", "info": "low_issues"}
    kinds = {"design_pattern": "design_patterns_count", "anti_pattern": "anti_patterns_count", "quality_issue": "code_quality_issues_count"}
    return patterns.agg(
        F.count("*").alias("total_patterns"), *(F.count_if(F.col("category") == k).alias(v) for k, v in kinds.items()), *(F.count_if(F.col("severity") == k).alias(v) for k, v in levels.items())
    )


def export_rows(patterns: DataFrame) -> DataFrame:
    """The ten columns of the table form."""
    return patterns.select(EXPORT)


def export(patterns: DataFrame, path: str, form: str = "json") -> None:
    """Writes all patterns as JSON lines or CSV; a Markdown report has the summary and a section for each."""
    if form == "json":
        patterns.write.mode("overwrite").json(path)
    elif form == "csv":
        export_rows(patterns).write.mode("overwrite").option("header", True).csv(path)
    elif form == "markdown":
        sections(patterns).select("section").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unsupported form {form!r}")


def sections(patterns: DataFrame) -> DataFrame:
    """One Markdown section for each design and anti pattern."""
    anti = F.col("category") == "anti_pattern"
    head = F.concat(F.lit("### "), F.initcap(F.replace("pattern_type", F.lit("_"), F.lit(" "))), F.when(anti, F.concat(F.lit(" ("), F.upper("severity"), F.lit(")"))).otherwise(""))
    lines = [
        head, F.lit(""), F.concat(F.lit("- **File**: `"), "file_path", F.lit("`")), F.concat(F.lit("- **Lines**: "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")),
        F.concat(F.lit("- **Confidence**: "), F.format_number("confidence", 2)), F.concat(F.lit("- **Description**: "), "description"),
        F.when(~anti, F.concat(F.lit("- **Benefits**: "), F.array_join("benefits", ", "))), F.when(anti, F.concat(F.lit("- **Problems**: "), F.array_join("problems", ", "))),
        F.when(anti, F.concat(F.lit("- **Solutions**: "), F.array_join("solutions", ", "))),
    ]
    return patterns.where("category <> 'quality_issue'").select("category", "file_path", F.concat_ws("\n", *lines).alias("section"))
