"""Many patterns in many texts: sharded Aho-Corasick automata over which texts stream."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the patterns of one automaton (about 100 bytes of memory each at most), and of the texts of one slice.
SHARD_CHARS, SLICE_CHARS = 2_000_000, 50_000_000


def contained(patterns: DataFrame, texts: DataFrame, shard_chars: int = SHARD_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """pattern: the distinct ones of patterns (pattern) that stand anywhere in a text of texts (text).

    Patterns are dealt to as many automata as their size asks for, distinct texts to slices; each pair of a shard and a
    slice is a task's stream, patterns first, of which only the automaton is held. Null and empty patterns and null
    texts are passed over."""
    patterns = patterns.where("length(pattern) > 0").select("pattern").distinct()
    texts = texts.where("length(text) > 0").select("text").distinct()
    shards, slices = ((df.agg(F.sum(F.length(df.columns[0]))).first()[0] or 0) // size + 1 for df, size in ((patterns, shard_chars), (texts, slice_chars)))

    def dealt(df: DataFrame, column: str, own: str, count: int, other: str, others: int, is_text: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64(column), F.lit(count)).alias(own)
        return df.select(mine, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other), F.lit(is_text).alias("is_text"), F.col(column).alias("value"))

    rows = dealt(patterns, "pattern", "shard", shards, "slice", slices, False).unionByName(dealt(texts, "text", "slice", slices, "shard", shards, True))
    rows = rows.select("shard", "slice", "is_text", "value").repartition(shards * slices, "shard", "slice").sortWithinPartitions("shard", "slice", "is_text")

    def run(batches):
        import ahocorasick

        at, automaton, built, seen = None, None, False, set()
        for batch in batches:
            found = []
            for shard, slice_, is_text, value in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (shard, slice_) != at:
                    at, automaton, built, seen = (shard, slice_), ahocorasick.Automaton(), False, set()
                if not is_text:
                    automaton.add_word(value, value)
                    continue
                if not built:
                    automaton.make_automaton()
                    built = True
                for _, pattern in automaton.iter(value) if len(automaton) else ():
                    if pattern not in seen:
                        seen.add(pattern)
                        found.append(pattern)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["pattern"])

    return rows.mapInArrow(run, "pattern string").distinct()
