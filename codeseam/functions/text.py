"""Column functions over paths, lines and code text. ASCII word borders, so that other engines agree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import COLOURS, DEBT_COLOURS, EMOJI, FILE_TYPES, literal_map


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored Java regex: * and ?, and [..] with ranges, negated by !."""
    out, k = [], 0
    while k < len(pattern):
        c, k = pattern[k], k + 1
        end = pattern.find("]", k + 1 + (pattern[k : k + 1] == "!")) if c == "[" else -1
        if end > 0:
            inner, k = pattern[k:end].replace("\\", r"\\"), end + 1
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else "\\" + inner if inner.startswith("^") else inner) + "]")
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
    return f"^{''.join(out)}$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))
    return F.coalesce(literal_map(FILE_TYPES)[suffix], F.lit("unknown"))


def is_test_file(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.rlike(r"^test_|_test\.|\.test\.|\.spec\.|_spec\.") | F.exists(F.split(F.lower(path), "/"), lambda s: s.isin("test", "tests", "__tests__", "spec", "specs"))


def _range(start: str, end: str, have: bool) -> Column:
    more = F.when(F.col(end).isNotNull() & (F.col(end) != F.col(start)), F.concat(F.lit("-"), F.col(end).cast("string"))).otherwise("") if have else F.lit("")
    return F.coalesce(F.concat(F.lit(":"), F.col(start).cast("string"), more), F.lit(""))


def location_text(columns: bool = False) -> Column:
    """file:start-end, and with columns :first-last behind it, as far as known."""
    parts = [F.col("file_path"), _range("line_start", "line_end", True)]
    return F.concat(*parts, _range("column_start", "column_end", True)) if columns else F.concat(*parts)


def title(x: Column) -> Column:
    """Every letter after something else than a letter is a capital, all others are small; also behind digits and hyphens."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")


def truncate(x: Column, length: int = 100) -> Column:
    return F.when(F.length(x) > length, F.concat(F.substr(x, F.lit(1), F.lit(length)), F.lit("..."))).otherwise(F.coalesce(x, F.lit("")))


def percentage(x: Column) -> Column:
    """One decimal and a percent sign; what is no number counts as none."""
    return F.concat(F.format_string("%.1f", F.bround(F.coalesce(x.try_cast("double"), F.lit(0.0)), 1)), F.lit("%"))


def minute(x: Column) -> Column:
    """Times in ISO form as yyyy-mm-dd hh:mm; other texts as they are."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.regexp_replace(x, "Z$", "+00:00")), "yyyy-MM-dd HH:mm"), x)


def severity_colour(x: Column) -> Column:
    return F.coalesce(literal_map(COLOURS)[F.lower(x)], F.lit("secondary"))


def debt_colour(x: Column) -> Column:
    value, out = x.try_cast("double"), F
    for least, colour in DEBT_COLOURS:
        out = out.when(value >= least, colour)
    return out.when(value.isNotNull(), "success").otherwise("secondary")


def emoji(x: Column) -> Column:
    return F.coalesce(literal_map(EMOJI)[F.lower(x)], F.lit("\u26aa"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9 _-]", ""), r"[ _-]+", "-")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: float = 0.0, key: Column | None = None) -> Column:
    """Seconds before an attempt. jitter: a share by which they may be longer or shorter, by a checksum of key, so that
    runs can be repeated."""
    wait = F.least(base * F.pow(F.lit(2), attempt), F.lit(most))
    if not jitter:
        return wait
    share = F.crc32((key if key is not None else attempt).cast("string")) / (2**32 - 1) * 2 - 1
    return wait * (1 + jitter * share)


def sorted_json(values: dict[str, Column]) -> Column:
    """A JSON object with its keys in order and without blanks."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))))


def keyword_count(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"))


def fill_template(template: str, columns: dict[str, Column]) -> Column:
    """{name} placeholders replaced by columns."""
    out = F.lit(template)
    for k, v in columns.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def lines_of_code(lines: DataFrame, comment: str = "#") -> DataFrame:
    """Lines with text that don't start as a comment."""
    t = strip(F.col("line"))
    return lines.groupBy("path").agg(F.count_if((t != "") & ~t.startswith(comment)).alias("loc"), F.count("*").alias("total_lines"))


def js_complexity(files: DataFrame) -> DataFrame:
    words = ("if", "else", "while", "for", "switch", "case", "catch")
    c = F.col("content")
    n = sum((keyword_count(c, w) for w in words), F.lit(1)) + F.regexp_count(c, F.lit(r"\?[^:\n]*:")) + F.regexp_count(c, F.lit(r"&&|\|\|"))
    return files.select("path", n.cast("long").alias("complexity"))


def js_counts(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return files.select("path", F.regexp_count(c, F.lit(r"function\s+\w+|=>")).cast("long").alias("functions"), keyword_count(c, "class").cast("long").alias("classes"), F.regexp_count(c, F.lit(r"(?m)^\s*import\s|require\(")).cast("long").alias("imports"))


def magic_numbers(lines: DataFrame) -> DataFrame:
    """Whole numbers of two digits and more, 100 and 1000 excepted; one row for each."""
    found = F.regexp_extract_all("line", F.lit(r"(?<![A-Za-z0-9_])[0-9]{2,}(?![A-Za-z0-9_])"), F.lit(0))
    return lines.select("path", "line_no", F.explode(found).alias("number")).where("number not in ('100', '1000')")


def promise_chains(lines: DataFrame) -> DataFrame:
    return lines.where(F.regexp_count("line", F.lit(r"\.then\(")) > 2)


def unhandled_promises(lines: DataFrame, ahead: int = 5) -> DataFrame:
    """.then( without .catch( on the line or in the next lines, as far as that many follow."""
    w = W.partitionBy("path").orderBy("line_no")
    caught = F.max(F.contains("line", F.lit(".catch(")).cast("int")).over(w.rowsBetween(0, ahead))
    n = F.max("line_no").over(W.partitionBy("path"))
    t = lines.withColumn("__c", caught).withColumn("__n", n)
    return t.where(F.contains("line", F.lit(".then(")) & (F.col("__c") == 0) & (F.col("line_no") < F.col("__n") - ahead + 0)).drop("__c", "__n")


def deep_indents(lines: DataFrame, most: int = 16) -> DataFrame:
    """Function starts indented by more than that many characters."""
    indent = F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))
    return lines.where((F.contains("line", F.lit("function(")) | F.contains("line", F.lit("=>"))) & (indent > most))


def gaps(lines: DataFrame, start_regex: str, most: int) -> DataFrame:
    """Starts whose next start is more than that many lines away; the last has no next."""
    w = W.partitionBy("path").orderBy("line_no")
    return lines.where(F.col("line").rlike(start_regex)).withColumn("gap", F.lead("line_no").over(w) - F.col("line_no")).where(F.col("gap") > most).select("path", "line_no", "gap")


def unused_variables(lines: DataFrame) -> DataFrame:
    """Declared names that stand on no other line than that of their last declaration: one aggregation of words."""
    declared = F.regexp_extract_all("line", F.lit(r"(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))
    words = F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))
    rows = lines.select("path", "line_no", declared.alias("declared"), F.explode(words).alias("name"))
    last = F.max(F.when(F.array_contains("declared", F.col("name")), F.col("line_no")))
    found = rows.groupBy("path", "name").agg(last.alias("line_no"), F.min("line_no").alias("__first"), F.max("line_no").alias("__last"))
    return found.where("line_no = __first and line_no = __last").drop("__first", "__last")


def repeated_lines(lines: DataFrame, key: str = "path") -> DataFrame:
    """Second and later occurrences of a line in its file, with the first's number."""
    w = W.partitionBy(key, "line").orderBy("line_no")
    t = lines.where(F.length("line") > 0).withColumn("__n", F.row_number().over(w)).withColumn("first_line", F.first("line_no").over(w))
    return t.where("__n > 1").drop("__n")
