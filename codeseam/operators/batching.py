"""Snippets and token-bounded batches for model calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import literal_map
from ..storage import dropped, written


def token_count(text: Column) -> Column:
    """Tokens of a text, estimated as a third of its characters."""
    return F.floor(F.length(text) / 3).cast("long")


TOKENIZED_CHARACTERS = 1 << 20  # texts of a worker's batch that are encoded at once


def with_tokens(texts: DataFrame, tokenizer: str, text: str = "content", name: str = "tokens") -> DataFrame:
    """texts with their exact token counts by a tokenizer's JSON file, without special tokens, in place of the estimate.

    The driver reads the file (some MB, whatever the table's size) and sends it along, so that executors need no copy.
    Whole texts count; a null text has null tokens, an empty one none."""
    from pathlib import Path

    shared = texts.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(shared.value)
        model.no_truncation()
        model.no_padding()
        for values in batches:
            out: list[int | None] = [None] * len(values)
            held, size = [], 0
            for k, v in enumerate(values):
                if v is not None:
                    held.append((k, v))
                    size += len(v)
                if held and (size >= TOKENIZED_CHARACTERS or k == len(values) - 1):
                    for (at, _), found in zip(held, model.encode_batch_fast([v for _, v in held], add_special_tokens=False)):
                        out[at] = len(found)
                    held, size = [], 0
            yield pd.Series(out, dtype="Int64")

    return texts.withColumn(name, counted(F.col(text)))


def chunks(files: DataFrame, lines_per_chunk: int = 40, overlap: int = 5, min_tokens: int = 10) -> DataFrame:
    """Overlapping line chunks of each file: number, first line, text, tokens (a third of the characters)."""
    return _cut(files, F.lit(lines_per_chunk), F.lit(max(1, lines_per_chunk - overlap)), min_tokens)


def _cut(files: DataFrame, lines: Column, step: Column, min_tokens: int) -> DataFrame:
    parts = F.split("content", "\n")
    c = files.select("path", parts.alias("p"), lines.cast("int").alias("n"), F.posexplode(F.sequence(F.lit(0), F.size(parts) - 1, step.cast("int"))).alias("chunk", "start"))
    text = F.array_join(F.slice("p", F.col("start") + 1, F.col("n")), "\n")
    return c.select("path", "chunk", (F.col("start") + 1).alias("first_line"), text.alias("text"), token_count(text).alias("tokens")).where(F.col("tokens") >= min_tokens)


def token_chunks(files: DataFrame, max_tokens: int = 8000, overlap_tokens: int = 200, min_tokens: int = 100) -> DataFrame:
    """Line chunks of about max_tokens, by the average tokens of a line of the file, that overlap by about overlap_tokens."""
    average = F.greatest(F.floor(F.length("content") / 3), F.lit(1)) / F.size(F.split("content", "\n"))
    lines = F.greatest(F.floor(max_tokens / average), F.lit(1))
    return _cut(files.where(F.length("content") > 0), lines, F.greatest(lines - F.floor(overlap_tokens / average), F.lit(1)), min_tokens)


#: Syntax nodes that make snippets, and what they are called.
SNIPPET_NODES = {"FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class", "Module": "module"}


#: What tree_snippets reads of a tree.
SNIPPETS = {"kinds": list(SNIPPET_NODES), "parents": list(SNIPPET_NODES), "columns": ["path", "node_id", "parent_id", "node_type", "name", "line"]}


def tree_snippets(tree: DataFrame, files: DataFrame, min_tokens: int = 100, max_tokens: int = 8000, context: int = 10) -> DataFrame:
    """Snippets of functions and classes: path, type, name, lines and text, from a node's line to the last line that a
    child begins on and some lines after it; those outside the band of tokens are left out."""
    kinds = literal_map(SNIPPET_NODES)
    own = F.when(kinds[F.col("node_type")].isNotNull(), F.struct(kinds[F.col("node_type")].alias("snippet_type"), "name", "line"))
    ids = F.array(F.struct(F.col("node_id").alias("id"), own.alias("own"), F.lit(None).cast("int").alias("last")), F.struct(F.col("parent_id").alias("id"), F.lit(None).alias("own"), F.col("line").alias("last")))
    # a node's row and those of its children meet in one aggregation, so that each tree is made once
    told = tree.where("line is not null").select("path", F.explode(ids).alias("x")).where("x.own is not null or x.id is not null and x.last is not null")
    spans = told.groupBy("path", "x.id").agg(F.max("x.own").alias("own"), F.max("x.last").alias("last")).where("own is not null").select("path", "own.*", "last")
    spans = spans.join(files.select("path", F.split("content", "\r?\n").alias("lines")), "path")
    end = F.least(F.size("lines"), F.greatest("line", F.coalesce("last", "line")) + context)
    text = F.array_join(F.slice("lines", F.col("line"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0))), "\n")
    cut = spans.withColumn("end_line", end).where("end_line > line").select("path", "snippet_type", F.coalesce("name", F.lit("anonymous")).alias("name"), F.col("line").alias("start_line"), "end_line", text.alias("text"))
    return cut.withColumn("tokens", token_count(F.col("text"))).where(F.col("tokens").between(min_tokens, max_tokens))


def whole_files(files: DataFrame, max_tokens: int = 8000) -> DataFrame:
    """One snippet for each file that fits a batch; larger files are for the cutters."""
    t = token_count(F.col("content"))
    lines = F.size(F.split(F.regexp_replace("content", r"\r?\n$", ""), "\n"))
    return files.where((F.length("content") > 0) & (t <= max_tokens)).select("path", F.lit("full_file").alias("snippet_type"), F.lit(1).alias("start_line"), lines.alias("end_line"), F.col("content").alias("text"), t.alias("tokens"))


def snippets(files: DataFrame, max_tokens: int = 8000, chunk_large_files: bool = True, **options) -> DataFrame:
    """path, tokens and text: whole files where they fit and chunking isn't asked for, else chunks of lines."""
    whole = whole_files(files, max_tokens) if not chunk_large_files else None
    rest = files if whole is None else files.where(token_count(F.col("content")) > max_tokens)
    cut = token_chunks(rest, max_tokens, **options).select("path", F.lit("chunk").alias("snippet_type"), F.col("first_line").alias("start_line"), "text", "tokens")
    return cut if whole is None else whole.select(cut.columns).unionByName(cut)


def priority(pattern_hits: Column, type_weight: Column, dependencies: Column) -> Column:
    return 1000 * pattern_hits + type_weight + 10 * dependencies


def next_fit(snippets: DataFrame, order: str, tokens: str, budget: int, scope: list[str] = ()) -> DataFrame:
    """batch_id of each snippet: batches are filled in order and closed when the next one doesn't fit (one that is larger than
    the budget is a batch of its own).

    With a scope, such as a source, each scope is one ordered stream of two narrow columns; without one the order is that
    of the whole input, and ranges of it are worked on at once (_next_fit_by_ranges). Null tokens count as none."""
    keys = list(scope)
    tokens_of = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("__t")
    rows = snippets.select(*keys, F.col(order).cast("long").alias("__o"), tokens_of)
    if not keys:
        return _next_fit_by_ranges(rows, order, budget)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "__o", "__t")
    k = len(keys)

    def run(batches):
        at, batch_id, total = None, 0, 0
        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(k + 2)]
            for row in zip(*cols):
                if row[:k] != at:
                    at, batch_id, total = row[:k], 0, 0
                if total and total + row[k + 1] > budget:
                    batch_id, total = batch_id + 1, 0
                total += row[k + 1]
                out.append(batch_id)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(k + 1)] + [pa.array(out, pa.int64())], keys + [order, "batch_id"])

    types = dict(snippets.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keys] + [f"`{order}` long", "batch_id long"]))


def _next_fit_by_ranges(rows: DataFrame, order: str, budget: int) -> DataFrame:
    """Next fit over one global order (__o, __t) without one task that reads it all.

    Rows are dealt by ranges and held, so that places and running sums are fixed. A batch that begins after a sum s of
    tokens ends before the first row whose running sum passes s + budget: a search in the range where that sum lies, for
    each distinct s. In a range these pointers are shortened to the first start behind it; from the first row on,
    pointers between ranges are doubled until every range knows where its first batch begins (as many rounds as the
    logarithm of the number of ranges); then all ranges walk at once. The driver sees a few numbers of each range."""
    spark = rows.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    held = written(rows.repartitionByRange("__o", "__t").sortWithinPartitions("__o", "__t").select(F.spark_partition_id().cast("long").alias("p"), place.alias("k"), "__o", "__t"))
    ranges = held.groupBy("p").agg(F.count("*").alias("n"), F.sum("__t").alias("t")).orderBy("p").collect()  # a row of each range
    if not ranges:
        return held.select(F.col("__o").alias(order), F.col("p").alias("batch_id"))
    number = {r.p: i for i, r in enumerate(ranges)}
    first = np.cumsum([0, *(r.n for r in ranges)])
    upto = np.cumsum([0, *(r.t for r in ranges)])
    grouped = held.groupBy("p")

    def sums(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        """The range's number, its rows' tokens in order, and the sums before them."""
        rows = rows.sort_by("k")
        at, t = number[rows["p"][0].as_py()], rows["__t"].to_numpy()
        return at, t, upto[at] + np.cumsum(t) - t

    def asked(rows: pa.Table) -> pa.Table:
        at, _, s = sums(rows)
        s = np.unique(s)
        to = np.searchsorted(upto[1:], s + budget, "right")  # the range whose running sums pass it first
        keep = to < len(ranges)
        ids = np.array([r.p for r in ranges], np.int64)
        return pa.table({"p": pa.array(ids[to[keep]]), "asker": pa.array(np.full(keep.sum(), ids[at])), "s": pa.array(s[keep])})

    def answered(rows: pa.Table, questions: pa.Table) -> pa.Table:
        out = {"p": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "next": pa.array([], pa.int64()), "crosses": pa.array([], pa.bool_())}
        if rows.num_rows and questions.num_rows:
            at, t, before = sums(rows)
            s = questions["s"].to_numpy()
            hit = np.searchsorted(before + t, s + budget, "right")
            to = first[at] + hit + (before[hit] <= s)  # an oversize row joins a batch that has no tokens yet
            asker = questions["asker"].to_numpy()
            ends = first[[number[a] + 1 for a in asker.tolist()]]
            keep = to < first[-1]
            out = {"p": pa.array(asker[keep]), "s": pa.array(s[keep]), "next": pa.array(to[keep]), "crosses": pa.array((to >= ends)[keep])}
        return pa.table(out)

    def pointers(rows: pa.Table, found: pa.Table) -> tuple[int, np.ndarray]:
        """The range's number and each row's next start (-1: none)."""
        at, _, before = sums(rows)
        found = found.sort_by("s")
        s, to = found["s"].to_numpy(), found["next"].to_numpy()
        where = np.searchsorted(s, before)
        known = where < len(s)
        known[known] = s[where[known]] == before[known]
        out = np.full(len(before), -1, np.int64)
        out[known] = to[where[known]]
        return at, out

    def exits(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "exit": pa.array([], pa.int64())})
        at, to = pointers(rows, found)
        low, high = int(first[at]), int(first[at + 1])
        out = to.tolist()
        for k in range(len(out) - 1, -1, -1):
            if low <= out[k] < high:
                out[k] = out[out[k] - low]
        return pa.table({"i": pa.array(np.arange(low, high)), "exit": pa.array(out, pa.int64())})

    questions = grouped.applyInArrow(asked, "p long, asker long, s long")
    nexts = written(grouped.cogroup(questions.groupBy("p")).applyInArrow(answered, "p long, s long, next long, crosses boolean"))
    by_asker = nexts.groupBy("p")
    entries = nexts.where("crosses").select(F.col("next").alias("e")).distinct().union(spark.range(1).select(F.col("id").alias("e")))
    jump = written(grouped.cogroup(by_asker).applyInArrow(exits, "i long, exit long").join(entries.distinct(), F.col("i") == F.col("e"), "left_semi"))
    starts = spark.range(1).select(F.col("id").alias("i"))
    for _ in range(len(ranges).bit_length()):
        further = starts.join(jump, "i").where("exit >= 0").select(F.col("exit").alias("i"))
        starts = written(starts.union(further).distinct())
        ahead = jump.select(F.col("i").alias("exit"), F.col("exit").alias("far"))
        jump = written(jump.join(ahead, "exit", "left").select("i", F.coalesce("far", F.lit(-1).cast("long")).alias("exit")))
    begins = {int(np.searchsorted(first, r.i, "right")) - 1: r.i for r in starts.collect()}  # one of each range at most

    def walked(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"p": pa.array([], pa.int64()), "__o": pa.array([], pa.int64()), "batch": pa.array([], pa.int64())})
        at, to = pointers(rows, found)
        marks, i = np.zeros(len(to), np.int64), begins.get(at, -1)
        while first[at] <= i < first[at + 1]:
            marks[i - first[at]] = 1
            i = int(to[i - first[at]])
        rows = rows.sort_by("k")
        return pa.table({"p": rows["p"], "__o": rows["__o"], "batch": pa.array(np.cumsum(marks))})

    told = written(grouped.cogroup(by_asker).applyInArrow(walked, "p long, `__o` long, batch long"))
    counts = dict(told.groupBy("p").agg(F.max("batch")).collect())
    before = np.cumsum([0, *(counts[r.p] for r in ranges)])
    offsets = spark.createDataFrame([(r.p, int(before[i]) - 1) for i, r in enumerate(ranges)], "q long, earlier long")
    dropped(held, nexts, jump)
    return told.join(offsets, F.col("p") == F.col("q")).select(F.col("__o").alias(order), (F.col("batch") + F.col("earlier")).alias("batch_id"))


def batch_totals(batched: DataFrame) -> DataFrame:
    """Snippets and tokens of each batch, and its files and lines where the snippets tell."""
    more = [F.countDistinct("path").alias("files")] if "path" in batched.columns else []
    more += [F.sum("lines").alias("lines")] if "lines" in batched.columns else []
    return batched.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), *more)


def batch_metadata(batched: DataFrame) -> DataFrame:
    """Of each batch: distinct files, languages and snippet types (sorted), and the number of distinct dependencies."""
    g = batched.groupBy("batch_id").agg(F.countDistinct("path").alias("file_count"), F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set("snippet_type")).alias("snippet_types"))
    d = batched.select("batch_id", F.explode("dependencies").alias("d")).groupBy("batch_id").agg(F.countDistinct("d").alias("total_dependencies"))
    return g.join(d, "batch_id", "left").fillna(0, ["total_dependencies"])


def batch_name(batch_id: Column) -> Column:
    """batch_001 for the first."""
    return F.format_string("batch_%03d", batch_id + 1)


def save_batches(batched: DataFrame, path: str) -> None:
    """All snippets, texts included, by batch, and the totals beside them."""
    batched.withColumn("id", batch_name(F.col("batch_id"))).write.mode("overwrite").partitionBy("batch_id").parquet(f"{path}/snippets")
    totals(batched).write.mode("overwrite").json(f"{path}/totals")


def load_batches(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snippets")


def totals(batched: DataFrame) -> DataFrame:
    return batched.agg(F.countDistinct("batch_id").alias("total_batches"), F.count("*").alias("total_snippets"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))


def analysed(prompts: DataFrame, analyser, key: str = "batch_id", attempts: int = 3) -> DataFrame:
    """key, response, error of each prompt (key, content): analyser is any function of a text, called up to that many times;
    a prompt that fails each time gives a row with its error, and the others go on."""

    def run(batches):
        for batch in batches:
            responses, errors = [], []
            for text in batch.column(1).to_pylist():
                for k in range(attempts):
                    try:
                        response, error = analyser(text), None
                        break
                    except Exception as e:  # noqa: BLE001  one prompt's failure isn't the job's
                        response, error = None, str(e)
                responses.append(response)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(responses, pa.string()), pa.array(errors, pa.string())], [key, "response", "error"])

    rows = prompts.select(key, "content")
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, response string, error string")


def with_batch(results: DataFrame, batches: DataFrame, key: str = "batch_id") -> DataFrame:
    """Results with their batch's columns; of several rows of one key the first by its columns counts."""
    first = batches.groupBy(key).agg(F.min(F.struct(*[c for c in batches.columns if c != key])).alias("b"))
    return results.join(first, key).select(*results.columns, "b.*")


def prompt(snippets: DataFrame, key: str, order: str) -> DataFrame:
    """The snippets of a batch as one text, in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    return snippets.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("// "), x["role"], F.lit("\n"), F.coalesce(x["text"], F.lit("")))), "\n").alias("content"))


def batch_size(effective_max: int, effective_per_minute: float, concurrency: int) -> int:
    return max(1000, min(effective_max, int(effective_per_minute / max(1, concurrency))))


def processing_seconds(n: int, batch: int, per_minute: float, concurrency: int) -> float:
    return -(-n // batch) / (min(per_minute, batch * concurrency * 60) / batch) * 60


def run_estimates(snippets: DataFrame, batch: int, per_minute: float, concurrency: int, price_in: float, price_out: float) -> DataFrame:
    """Seconds and costs of a whole run by the formulas above, from the sums of one pass."""
    n, t = F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))
    rate = min(per_minute, batch * concurrency * 60) / batch
    out = F.floor(t * 0.2)
    return snippets.agg(n.alias("snippets"), t.alias("tokens"), (F.ceil(t / batch) / rate * 60).alias("seconds"), out.alias("tokens_out"), ((t * price_in + out * price_out) / 1e6).alias("cost"))


def estimate_cost(tokens_in: int, price_in: float, price_out: float, share_out: float = 0.2) -> float:
    return (tokens_in * price_in + int(share_out * tokens_in) * price_out) / 1e6
