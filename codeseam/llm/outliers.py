"""Quality rules: robust multivariate outliers among document statistics, per language and source.

DataFrame functions only. Statistics are counted from whole texts; groups' centres and covariances are
minimum-covariance-determinant estimates: from three deterministic starts (quartiles, spatial signs, clipped
values) concentration steps move to the rows nearest to the last estimate until the determinant stops falling,
and a document goes if its Mahalanobis distance from its group's estimate is too large.

Statistics are rounded to thousandths, so sums of products are whole numbers and don't depend on the order of
addition. Distances are put into narrow classes, and a step takes whole classes until they hold the wanted
share: a group of any size needs the memory of one histogram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, stored

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Base rules: least words, and the largest percentage of words in repeated windows of three.
LEAST_WORDS, MOST_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The vector: logarithms of words and of a word's mean length, of symbols in 1,000 characters, of repeated lines and
#: of words in repeated windows in 100; each with the deviation below which differences mean nothing, which is added
#: to the covariance (whole columns may be constant).
FLOORS = {"words": 0.1, "length": 0.03, "symbols": 0.5, "lines": 1.0, "repeats": 1.0}
DIMS = len(FLOORS)
UNIT = 1000.0
#: Share of a group's rows whose determinant is minimised, the least rows of a group, and the squared distance
#: (chi-square, 5 degrees: 1 in 7 million) beyond which a row goes.
SHARE, LEAST_ROWS, CUTOFF = 0.75, 100, 40.0
#: Steps from every start, and at most from the best one; a fall of the log-determinant under EPSILON ends them.
FIRST_STEPS, MOST_STEPS, EPSILON = 2, 20, 1e-4
#: Distance classes to one of ln(1 + d2), and the last of them.
CLASSES, LAST_CLASS = 100, 3000
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _bound(value: Column, use) -> Column:
    """use(value), where value is computed once although use's lambdas read it for each element."""
    return F.transform(F.array(value), use)[0]


def _windows(words: Column) -> Column:
    """Windows of three words."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))


def _repeated(hashes: Column, words: Column) -> Column:
    """How many words lie in windows of three (whose hashes are given) that are found twice or more.

    Where all hashes differ there are none. Else windows are sorted by hash and place in one long each, and neighbours
    of one hash are compared word by word; where two of these differ after all, the windows' words themselves are
    sorted instead. Linear but for the sort."""
    left, right = (lambda *a: F.call_function("shiftleft", *a)), (lambda *a: F.call_function("shiftright", *a))

    def sorted_out(b: Column) -> Column:
        return _bound(_windows(words), lambda windows: by_place(b, windows))

    def by_place(b: Column, windows: Column) -> Column:
        def place(x):
            return (x - left(right(x, b), b)).cast("int")

        def judged(s: Column) -> Column:
            neighbours = F.arrays_zip(F.slice(s, 1, F.size(s) - 1).alias("p"), F.slice(s, 2, F.size(s) - 1).alias("q"))
            return _bound(F.filter(neighbours, lambda x: right(x["p"], b) == right(x["q"], b)), of_pairs)

        def of_pairs(found: Column) -> Column:
            true = F.forall(found, lambda x: F.get(windows, place(x["p"])) == F.get(windows, place(x["q"])))
            at = F.array_union(F.transform(found, lambda x: place(x["p"])), F.transform(found, lambda x: place(x["q"])))
            return F.when(true, _covered(at)).otherwise(_bound(_sorted_texts(windows), lambda t: _covered(_repeated_places(t))))

        return _bound(F.sort_array(F.transform(hashes, lambda h, i: left(right(h, b), b) + i)), judged)

    bits = F.length(F.bin(F.size(hashes)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_bound(bits, sorted_out)).cast("long")


def _covered(places: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))


def _sorted_texts(windows: Column) -> Column:
    """Windows as texts with their places behind them, sorted: words hold no blank, so equal windows are neighbours."""
    return F.sort_array(F.transform(windows, lambda x, i: F.concat_ws(" ", x["a"], x["b"], x["c"], i.cast("string"))))


def _repeated_places(texts: Column) -> Column:
    n = F.size(texts) - 1
    pairs = F.arrays_zip(F.slice(texts, 1, n).alias("p"), F.slice(texts, 2, n).alias("q"))
    found = F.filter(pairs, lambda x: F.substring_index(x["p"], " ", 3) == F.substring_index(x["q"], " ", 3))
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(*(F.substring_index(x[k], " ", -1).cast("int") for k in "pq")))))


def document_statistics(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """doc_id, the columns of by (as text; null where docs lacks them), the counts of COUNTS (long), one row for each row.

    Null text has no words. Whole texts of any length are read, in time n log n at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one_blank = F.when(text.rlike("[\\x09\\x0B-\\x0D]"), F.translate(text, SPACES[1:], " " * 5)).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    names = [f"by_{i}" for i in range(len(by))]
    keys = [(F.col(k).cast("string") if k in docs.columns else F.lit(None).cast("string")).alias(n) for k, n in zip(by, names)]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *keys, text.alias("t"), F.array_remove(F.split(one_blank, " "), "").alias("w"),
        F.length(F.replace(one_blank, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
    )
    rows = rows.select("*", F.transform(_windows(F.col("w")), lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("h"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    symbols = F.length("t") - F.length(F.translate("t", SYMBOLS, ""))
    return rows.select(
        "doc_id", *names, F.size("w").cast("long").alias("n_words"), "word_chars",
        F.when(F.col("t").rlike("[#*$%&|<>]"), symbols).otherwise(0).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("h"), F.col("w")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    parts = (F.log(n), F.log(chars / n), F.log1p(1000 * F.col("n_symbols") / chars), F.log1p(F.col("n_dup_lines")), F.log1p(100 * F.col("n_repeat_words") / n))
    return [F.round(UNIT * x).cast("double").alias(f"x{i}") for i, x in enumerate(parts)]


def _group_keys(stats: DataFrame, by: int, least_rows: int) -> DataFrame:
    """by_*, n, key: rows of a combination of by, and the group whose estimate judges them: the combination itself, the
    small ones of one by_0 together, all small ones of those together; null where even these are too few."""
    names = [f"by_{i}" for i in range(by)]
    sizes = stats.groupBy(*names).agg(F.count("*").alias("n"))
    told = F.to_json(F.struct(*names))
    first = F.to_json(F.struct(*names[:1], F.lit(True).alias("rest")))
    small = sizes.where(F.col("n") < least_rows).groupBy(first.alias("first")).agg(F.sum("n").alias("n_first"))
    rest = small.where(F.col("n_first") < least_rows).agg(F.sum("n_first")).first()[0] or 0
    out = sizes.withColumn("first", first).join(small, "first", "left")
    key = F.when(F.col("n") >= least_rows, told).when(F.col("n_first") >= least_rows, F.col("first")).when(F.lit(rest) >= least_rows, F.lit("{}"))
    return out.select(*names, key.alias("key"))


def _plus(terms) -> str:
    return " + ".join(terms)


def _inverted(df: DataFrame, keys: list[str]) -> DataFrame:
    """m_i stay; c_ij (symmetric, positive definite) become v_ij of the inverse, and logdet, by Cholesky's factor l and its inverse w.

    Aliases of one select list build on each other."""
    held = [f"{k}" for k in keys] + [f"m{i}" for i in range(DIMS)]
    steps = []
    for j in range(DIMS):
        steps.append(f"sqrt(c{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(j))}) AS l{j}{j}")
        steps += [f"(c{j}{i}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, DIMS)]
    steps += [f"1 / l{j}{j} AS w{j}{j}" for j in range(DIMS)]
    for d in range(1, DIMS):
        steps += [f"-({_plus(f'l{j + d}{k} * w{k}{j}' for k in range(j, j + d))}) / l{j + d}{j + d} AS w{j + d}{j}" for j in range(DIMS - d)]
    inverse = [f"{_plus(f'w{k}{i} * w{k}{j}' for k in range(j, DIMS))} AS v{i}{j}" for i, j in PAIRS]
    logdet = f"2 * ({_plus(f'ln(l{i}{i})' for i in range(DIMS))}) AS logdet"
    return df.selectExpr(*held, *steps, *inverse, logdet).select(*held, *(f"v{i}{j}" for i, j in PAIRS), "logdet")


def _estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """From n, s_i and p_ij: centre m_i, inverse v_ij of the covariance with floors, and its log-determinant."""
    floors = [f" + {(UNIT * f) ** 2}D" for f in FLOORS.values()]
    cov = [f"p{i}{j} / n - (s{i} / n) * (s{j} / n){floors[i] if i == j else ''} AS c{i}{j}" for i, j in PAIRS]
    return _inverted(sums.selectExpr(*keys, *(f"s{i} / n AS m{i}" for i in range(DIMS)), *cov), keys)


def _distance() -> str:
    """Squared Mahalanobis distance of x_i from m_i by v_ij."""
    return _plus(f"{1 if i == j else 2} * v{i}{j} * (x{i} - m{i}) * (x{j} - m{j})" for i, j in PAIRS)


def _class() -> str:
    return f"CAST(least(floor({CLASSES} * ln(1 + greatest({_distance()}, 0D))), {LAST_CLASS}) AS INT)"


def _sums() -> list[Column]:
    return [F.expr(f"sum(x{i}) AS s{i}") for i in range(DIMS)] + [F.expr(f"sum(x{i} * x{j}) AS p{i}{j}") for i, j in PAIRS]


def _step(rows: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """One concentration step for each key and start: the estimate over the classes of nearest rows that hold the share."""
    near = rows.join(estimate, "key").selectExpr("key", "start", f"{_class()} AS class")
    counts = near.groupBy("key", "start", "class").agg(F.count("*").alias("k"))
    order = Window.partitionBy("key", "start").orderBy("class")  # a key has LAST_CLASS + 1 classes at most
    whole = Window.partitionBy("key", "start")
    reached = counts.withColumns({"upto": F.sum("k").over(order), "all": F.sum("k").over(whole)}).where(F.col("upto") - F.col("k") < share * F.col("all"))
    last = reached.groupBy("key", "start").agg(F.max("class").alias("last"))
    told = stored(estimate.join(last, ["key", "start"]))
    taken = rows.join(told, "key").where(f"{_class()} <= last")
    out = stored(_estimate(taken.groupBy("key", "start").agg(F.count("*").alias("n"), *_sums()), ["key", "start"]))
    drop_stored(told)
    return out


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates for each key: quartiles, spatial signs and values clipped at two deviations around them."""
    ten = 10
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") / ten).cast("int").alias("v")) for i in range(DIMS))))
    counts = rows.select("key", values.alias("u")).groupBy("key", F.col("u.i").alias("i"), F.col("u.v").alias("v")).agg(F.count("*").alias("k"))
    order, whole = Window.partitionBy("key", "i").orderBy("v"), Window.partitionBy("key", "i")
    upto = counts.withColumns({"upto": F.sum("k").over(order), "all": F.sum("k").over(whole)})
    quartile = {q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("v"))).alias(f"q{q}") for q in (1, 2, 3)}
    by_dim = upto.groupBy("key", "i").agg(*quartile.values())
    floors = F.array(*(F.lit(UNIT * f) for f in FLOORS.values()))
    scale = F.sqrt(F.pow((F.col("q3") - F.col("q1")) * ten / 1.349, 2) + F.pow(F.get(floors, F.col("i")), 2))
    spread = by_dim.select("key", "i", (F.col("q2") * ten + ten / 2).alias("m"), scale.alias("d"))
    at = [F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for c in "md" for i in range(DIMS)]
    wide = stored(spread.groupBy("key").agg(*at))

    z = [f"(x{i} - m{i}) / d{i}" for i in range(DIMS)]
    norm = f"sqrt({_plus(f'({x}) * ({x})' for x in z)})"
    kinds = {1: [f"round(if({norm} > 0, {UNIT} * {x} / {norm}, 0D))" for x in z], 2: [f"round({UNIT} * least(greatest({x}, -2D), 2D))" for x in z]}
    near = rows.join(wide, "key").selectExpr("key", *(f"{x} AS y{k}{i}" for k, v in kinds.items() for i, x in enumerate(v)))
    products = near.groupBy("key").agg(F.count("*").alias("n"), *(F.expr(f"sum(y{k}{i} * y{k}{j}) AS u{k}{i}{j}") for k in kinds for i, j in PAIRS))
    both = stored(products.join(wide, "key"))
    drop_stored(wide)
    centre = [f"m{i}" for i in range(DIMS)]
    frames = [_inverted(both.selectExpr("key", "0 AS start", *centre, *(f"{f'd{i} * d{i}' if i == j else '0D'} AS c{i}{j}" for i, j in PAIRS)), ["key", "start"])]
    for k in kinds:
        trace = f"greatest({_plus(f'u{k}{i}{i}' for i in range(DIMS))}, 1D)"
        unit = f"{DIMS} / {trace}" if k == 1 else f"1 / (n * {UNIT * UNIT}D)"  # signs tell a shape only: mean variance 1
        floors = [f" + {(UNIT * f) ** 2}D" for f in FLOORS.values()]
        c = [f"u{k}{i}{j} * ({unit}) * d{i} * d{j}{floors[i] if i == j else ''} AS c{i}{j}" for i, j in PAIRS]
        frames.append(_inverted(both.selectExpr("key", f"{k} AS start", *centre, *c), ["key", "start"]))
    out = stored(reduce(DataFrame.unionByName, frames))
    drop_stored(both)
    return out


def _best(estimate: DataFrame) -> DataFrame:
    """Of a key's starts the one of the least determinant; of equal ones the first."""
    least = Window.partitionBy("key").orderBy("logdet", "start")
    return stored(estimate.withColumn("r", F.row_number().over(least)).where("r = 1").drop("r"))


def robust_estimates(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """key, m_i, v_ij, logdet: the estimate of every key of rows (key, x_i)."""
    now = _starts(rows)
    for _ in range(FIRST_STEPS):
        before, now = now, _step(rows, now, share)
        drop_stored(before)
    before, now = now, _best(now)
    drop_stored(before)
    for _ in range(MOST_STEPS):
        after = _step(rows, now, share)
        was = now.select("key", F.col("logdet").alias("was"))
        fall = after.join(was, "key").agg(F.max(F.abs(F.col("was") - F.col("logdet")))).first()[0]
        drop_stored(now)
        now = after
        if fall is None or fall < EPSILON:
            break
    return now


def outlier_scores(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), share: float = SHARE, least_rows: int = LEAST_ROWS, text_col: str = "text") -> DataFrame:
    """doc_id, the counts of COUNTS, base_failed, distance (squared Mahalanobis; null where base rules failed or no group is
    large enough), one row for each row of docs.

    Estimates are made from the rows that pass the base rules. Combinations of by under least_rows rows are judged
    together with the others of their first column, then with all such; if even these are too few, base rules alone
    decide. Null keys are a value of their own, columns of by that docs lacks are null, null text has no words (so the
    base rules fail), repeated rows and shared doc_ids are judged row by row, other columns are ignored, an empty
    table gives an empty one."""
    n = len(by)
    stats = stored(document_statistics(docs, by, text_col).withColumn("base_failed", base_failed()))
    keys = stored(_group_keys(stats.where(~F.col("base_failed")), n, least_rows))
    same = reduce(lambda a, b: a & b, (stats[f"by_{i}"].eqNullSafe(keys[f"by_{i}"]) for i in range(n)))
    told = stats.join(keys, same & ~stats["base_failed"], "left").select("doc_id", *COUNTS, "base_failed", keys["key"])
    judged = stored(told.select("*", *_vector()))
    rows = judged.where("key is not null").select("key", *(f"x{i}" for i in range(DIMS)))
    estimate = robust_estimates(rows, share)
    out = judged.join(estimate.drop("start", "logdet"), "key", "left").select("doc_id", *COUNTS, "base_failed", F.expr(_distance()).alias("distance"))
    drop_stored(stats, keys)
    return out


def digest_outliers(scored: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return scored.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), F.round("distance", 3).alias("distance"))


def keep_inliers(docs: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects: by doc_id, of which a null or shared one goes only if all
    its rows are rejected."""
    good = digest_outliers(outlier_scores(docs, **options), cutoff).where("kept").select(F.col("doc_id").alias("good_id")).distinct()
    return docs.join(good, docs["doc_id"].cast("long").eqNullSafe(good["good_id"]), "left_semi")
