"""Texts that contain each other, found by rare q-grams instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3


def grams_of(text: str) -> set[str]:
    return {text[i : i + Q] for i in range(len(text) - Q + 1)}


class Containment:
    """Texts in order of arrival; first(t) is the earliest that contains t or that t contains.

    A text that contains t has all of t's q-grams, so the shortest of their lists holds it; a text that t contains is
    filed under one of its own q-grams, the rarest when it came, which t must have. Equal texts count once."""

    def __init__(self):
        self.texts: list[str] = []
        self.place: dict[str, int] = {}
        self.having: dict[str, list[int]] = {}
        self.filed: dict[str, list[int]] = {}
        self.short: list[int] = []

    def add(self, text: str) -> int:
        """The text's number: that of its first arrival."""
        if text in self.place:
            return self.place[text]
        n = self.place[text] = len(self.texts)
        self.texts.append(text)
        grams = grams_of(text)
        if grams:
            rarest = min(grams, key=lambda g: (len(self.having.get(g, ())), g))
            self.filed.setdefault(rarest, []).append(n)
            for g in grams:
                self.having.setdefault(g, []).append(n)
        else:
            self.short.append(n)
        return n

    def first(self, text: str) -> int | None:
        found = [self.place[text]] if text in self.place else []
        grams = grams_of(text)
        lists = [self.having.get(g, ()) for g in grams]
        longer = min(lists, key=len) if grams else range(len(self.texts))
        found += [next((n for n in longer if text in self.texts[n]), None)]
        for numbers in (self.short, *(self.filed.get(g, ()) for g in grams)):
            found.append(next((n for n in numbers if self.texts[n] in text), None))
        return min((n for n in found if n is not None), default=None)


class Leaders:
    """The leaders of one scope, in order of arrival: by rule, by title and by message."""

    def __init__(self):
        self.rules: dict[str, tuple] = {}
        self.texts = Containment(), Containment()
        self.heads: tuple[list[tuple], list[tuple]] = ([], [])

    def add(self, head: tuple, rule: str | None, texts: tuple[str, str]) -> None:
        if rule:
            self.rules.setdefault(rule, head)
        for index, heads, text in zip(self.texts, self.heads, texts):
            if text and index.add(text) == len(heads):
                heads.append(head)

    def first(self, rule: str | None, texts: tuple[str, str]) -> tuple | None:
        found = [self.rules.get(rule)] if rule else []
        for index, heads, text in zip(self.texts, self.heads, texts):
            n = index.first(text) if text else None
            found.append(None if n is None else heads[n])
        return min((h for h in found if h), default=None)


def _grams(text: Column, q: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substr(text, i, F.lit(q))))


def containing(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, inner, outer: the numbers of rows (keys, n, text) of which one text contains the other; equal texts both ways.

    Each text is sought by its rarest q-gram (a shorter one by itself) among the q-grams of the texts that share its
    keys: an equi-join, whose pairs are then compared. Null and empty texts contain and are in nothing."""
    rows = texts.where("length(text) > 0").select(*keys, "n", "text")
    long = rows.where(F.length("text") >= Q).select(*keys, "n", "text", F.explode(_grams(F.col("text"), Q)).alias("gram"))
    often = long.groupBy(*keys, "gram").agg(F.count("*").alias("k"))
    held = long.join(often, [*keys, "gram"])
    rarest = held.groupBy(*keys, "n").agg(F.min(F.struct("k", "gram"))["gram"].alias("gram"), F.first("text").alias("inner_text"))
    pairs = rarest.withColumnRenamed("n", "inner").join(long.withColumnRenamed("n", "outer"), [*keys, "gram"])
    brief = rows.where(F.length("text") < Q)
    near = rows.join(brief.select(*keys).distinct(), keys, "left_semi")
    parts = F.array_distinct(F.flatten(F.array(*(F.when(F.length("text") >= q, _grams(F.col("text"), q)).otherwise(F.array().cast("array<string>")) for q in range(1, Q)))))
    short = brief.select(*keys, F.col("n").alias("inner"), F.col("text").alias("inner_text"), F.col("text").alias("gram")).join(
        near.select(*keys, F.col("n").alias("outer"), "text", F.explode(parts).alias("gram")), [*keys, "gram"]
    )
    both = [x.select(*keys, "inner", "outer", "inner_text", "text") for x in (pairs, short)]
    return both[0].union(both[1]).where(F.contains("text", F.col("inner_text")) & (F.col("inner") != F.col("outer"))).select(*keys, "inner", "outer")
