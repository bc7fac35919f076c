"""Row-wise enrichment: debt, impacts, security mapping, remediation, business impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEBT_BASE, DEBT_FACTOR, SECURITY_TYPES, literal_map

#: Texts that point to weaknesses, in order of precedence.
SECURITY_TEXTS = [
    ("sql injection", ["CWE-89"], ["A03:2021 – Injection"], ["PCI-DSS", "SOX"]),
    ("xss", ["CWE-79"], ["A03:2021 – Injection"], ["PCI-DSS"]),
    ("authentication", ["CWE-287", "CWE-306"], ["A07:2021 – Identification and Authentication Failures"], ["PCI-DSS", "HIPAA"]),
]


def debt(half_even: bool = True) -> Column:
    base = F.coalesce(literal_map(DEBT_BASE)[F.col("severity")], F.lit(5.0))
    factor = F.coalesce(literal_map(DEBT_FACTOR)[F.col("finding_type")], F.lit(1.0))
    value = base * factor * F.col("confidence")
    return F.bround(value, 2) if half_even else F.floor(value * 100 + 0.5) / 100


def _three(of: Column) -> Column:
    return F.when(of.isin("high", "critical"), "high").when(of == "medium", "medium").otherwise("low")


def impacts() -> dict[str, Column]:
    t, s = F.col("finding_type"), F.col("severity")
    return {
        "maintainability_impact": F.when(t.isin("code_smell", "anti_pattern", "style_violation", "missing_documentation"), _three(s)).otherwise("minimal"),
        "security_impact": F.when(t.isin(SECURITY_TYPES), F.when(s.isin("critical", "high", "medium"), s).otherwise("low")).otherwise("minimal"),
        "performance_impact": F.when(t.isin("performance_issue", "memory_leak", "inefficient_algorithm"), s).otherwise("minimal"),
        "reliability_impact": F.when(t.isin("memory_leak", "performance_issue", "syntax_error", "flaky_test"), s).otherwise("minimal"),
    }


def business_impact() -> Column:
    return F.when(F.col("finding_type").isin("security_vulnerability", "performance_issue", "memory_leak"), _three(F.col("severity"))).otherwise("low")


def security_map(text: Column) -> dict[str, Column]:
    low = F.lower(text)

    def pick(i):
        out = F.when(F.lit(False), F.array().cast("array<string>"))
        for row in SECURITY_TEXTS:
            out = out.when(low.contains(row[0]), F.array(*map(F.lit, row[i])))
        return out.otherwise(F.array().cast("array<string>"))

    return {"cwe_ids": pick(1), "owasp_categories": pick(2), "compliance_violations": pick(3)}


#: Patterns that findings of two types may be, told by their key in the rule or, with blanks, in the title.
PATTERN_INFO = [
    ("anti_pattern", "god_object", "God Object", "anti_pattern", "A class that knows too much or does too much", 0.85, ["Large class size", "Multiple responsibilities", "High coupling"], ["single_responsibility_violation", "high_coupling"]),
    ("anti_pattern", "spaghetti_code", "Spaghetti Code", "anti_pattern", "Code with complex and tangled control flow", 0.75, ["Complex control flow", "Nested conditions", "No clear structure"], []),
    ("design_pattern", "singleton", "Singleton Pattern", "creational_pattern", "Ensures a class has only one instance", 0.92, ["Private constructor", "Static instance method", "Single instance guarantee"], []),
]
_INFO = "struct<pattern_id:string,pattern_name:string,pattern_category:string,description:string,confidence_score:double,evidence:array<string>,related_patterns:array<string>>"
#: What to do about findings of a type: priority, category, description, steps, effort, risk.
REMEDIATION = {
    "security_vulnerability": ("immediate", "fix", "Address security vulnerability immediately", ["Review the vulnerable code section", "Apply security patches or updates", "Implement input validation if applicable", "Add security tests", "Conduct security review"], "medium", "high"),
    "code_smell": ("medium", "refactor", "Refactor code to improve maintainability", ["Identify the root cause of the code smell", "Extract methods or classes as needed", "Improve naming and structure", "Add or update documentation", "Write unit tests for refactored code"], "medium", "low"),
    "anti_pattern": ("high", "refactor", "Restructure code to eliminate anti-pattern", ["Analyze the current structure", "Design a better architecture", "Break down large components", "Apply SOLID principles", "Incrementally refactor"], "high", "medium"),
    "outdated_dependency": ("medium", "modernize", "Update dependencies to latest stable versions", ["Check for breaking changes in newer versions", "Update dependencies incrementally", "Run comprehensive tests", "Update documentation if needed"], "low", "medium"),
}
_STEPS = "struct<priority:string,category:string,description:string,steps:array<string>,estimated_effort:string,risk_level:string,code_example:string>"


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def pattern_info() -> Column:
    """The pattern that a finding is, if it is one of the known."""
    out = F.when(F.lit(False), F.lit(None).cast(_INFO))
    for kind, key, name, category, text, score, evidence, related in PATTERN_INFO:
        told = F.coalesce(F.lower("rule_id").contains(key), F.lit(False)) | F.coalesce(F.lower("title").contains(key.replace("_", " ")), F.lit(False))
        info = F.struct(F.lit(key), F.lit(name), F.lit(category), F.lit(text), F.lit(score), _texts(evidence), _texts(related)).cast(_INFO)
        out = out.when((F.col("finding_type") == kind) & told, info)
    return out


def remediation_plan(suggestion: Column, fix: Column) -> Column:
    """What to do about a finding by its type; its own suggestion stands for the description, and then its fix is the example."""
    own = F.length(suggestion) > 0
    out = F.when(F.lit(False), F.lit(None).cast(_STEPS))
    for kind, (priority, category, text, steps, effort, risk) in REMEDIATION.items():
        plan = F.struct(F.lit(priority), F.lit(category), F.when(own, suggestion).otherwise(text), _texts(steps), F.lit(effort), F.lit(risk), F.when(own & (F.length(fix) > 0), fix)).cast(_STEPS)
        out = out.when(F.col("finding_type") == kind, plan)
    return out


def enrich(findings: DataFrame, half_even: bool = True) -> DataFrame:
    """Findings with debt, the impact map, business impact, security mapping, pattern and remediation."""
    imp = impacts()
    have = {c: F.coalesce(F.col(c), F.lit("")) if c in findings.columns else F.lit("") for c in ("description", "suggestion", "fix_recommendation")}
    text = F.concat_ws(" ", "title", have["description"], "message")
    return findings.withColumns({
        "technical_debt_score": debt(half_even), "impact_analysis": F.create_map(*(x for k, v in imp.items() for x in (F.lit(k), v))), "business_impact": business_impact(), **security_map(text),
        "pattern_info": pattern_info(), "remediation": remediation_plan(have["suggestion"], have["fix_recommendation"]),
    })


def remediation(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """Left join with a small dimension (finding_type, steps, effort); the finding's own suggestion wins where present."""
    return findings.join(templates, "finding_type", "left")
