"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Where a pattern could start anywhere inside a long run of characters, it is
anchored to the run's start or to the end of the previous match, which finds the same leftmost
non-overlapping matches in linear time; group repetitions are possessive, which Java's engine runs
as loops and not by recursion, so texts of any length are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, cheap test that any text with a match passes)
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\."),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
    "iban": (r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
}
BASE = ("email", "ip", "card", "phone")
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "(?i)e-?mail|contact|write to|correo|courriel|address",
    "ip": r"(?i)(?<!\w)ip(?!\w)|server|host|addr|network",
    "card": "(?i)card|visa|credit|debit|karte|carte|tarjeta|payment",
    "phone": "(?i)phone|call|tel|mobile|fax|anruf|appel",
    "iban": "(?i)iban|account|bank|konto|compte|cuenta",
}
START_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.6}
CONFIRMED, NEARBY, WINDOW = 0.3, 0.2, 40
SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, cross sums added: a multiple of 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    weighed = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064: country and check digits moved to the end, letters as 10..35, remainder 1."""
    x = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c == "", None).when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v.isNull(), a).when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97).cast("int")) == 1


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(x))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & mod97(x)
    return F.lit(True)


#: Matches whose places are summed up one by one; longer lists go block by block, so work stays in proportion.
BLOCK = 256


PLACED = "array<struct<start:int,end:int,value:string,around:string>>"


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, offsets in code points: the text between matches gives their places. The words
    that adjust a score stand at most WINDOW characters away, and not beyond the next match of the kind."""
    pattern, test = PATTERNS[kind]
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(PLACED)
    steps = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("before"), F.slice(gaps, 2, F.size(found)).alias("after"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x["before"]) + F.length(x["m"])))
    starts = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )

    def place(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        near = F.substr(x["before"], F.greatest(F.length(x["before"]) - WINDOW, F.lit(0)) + 1)
        around = F.concat(near, F.lit(" "), F.substr(x["after"], F.lit(1), F.lit(WINDOW)))
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"), around.alias("around"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).cast(PLACED).alias("out"))

    placed = F.flatten(F.zip_with(parts, starts, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), empty.alias("out")), place, lambda acc: acc["out"])))
    checked = F.filter(placed, lambda s: _valid(kind, s["value"]))
    base = START_SCORE[kind] + (CONFIRMED if kind in ("card", "iban") else 0.0)

    def scored(s):
        score = F.least(F.lit(1.0), base + F.when(s["around"].rlike(CONTEXT[kind]), NEARBY).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    return F.when(text.rlike(test), F.transform(checked, scored).cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii: all confirmed spans (kind, start, end, value, score) by start, then kind as in PATTERNS.

    Null text has none (as empty text); whole texts of any length are read, in time in proportion; every row gives
    one row, repeated ones too; an empty table gives an empty one; other columns stay, but one named pii is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.create_map(*(x for i, k in enumerate(PATTERNS) for x in (F.lit(k), F.lit(i))))
    found = F.concat(*(_spans(text, k) for k in PATTERNS))

    def before(a, b):
        ka, kb = order[a["kind"]], order[b["kind"]]
        return F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (ka < kb)), -1).when((a["start"] == b["start"]) & (ka == kb), 0).otherwise(1)

    return docs.withColumn("pii", F.when(F.size(found) > 0, F.array_sort(found, before)).otherwise(found))


def digest_pii(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans as text and their scores in percent."""
    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    scores = F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string"))
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"), F.array_join(scores, ",").alias("scores"))


def redact(found: DataFrame, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The text with every span of at least min_score replaced by [KIND]; overlapping spans as one."""
    spans = F.filter("pii", lambda s: s["score"] >= min_score)
    built = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substr(F.col(text_col), acc["at"] + 1)),
    )
    return found.withColumn(text_col, F.when(F.size(spans) > 0, built).otherwise(F.col(text_col)))
