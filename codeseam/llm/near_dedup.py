"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes is evaluated once and gives two signature values, its minimum
and its maximum; bands mix minima and maxima of different permutations. Bands propose candidates,
full shingle sets decide. The work per step:

1. one pass over the texts: set size, set digest, band keys (``signatures``);
2. equal sets collapse to one representative, so groups of copies cost one row;
3. representatives are sorted by (band key, id) and cut into ranges, which may cut a bucket too; each meets the
   smallest one of its bucket in its range (a star: linear), and the smallest ones of a cut bucket meet;
4. components of the confirmed links; buckets that now lie inside one component are finished;
5. small unfinished buckets are compared as distinct pairs across components; the members of large ones, texts
   that share much boilerplate, get exact keys, the shingles at the begin of each set when rare ones come first,
   and go through steps 3 to 5 again;
6. what is large and unfinished even then is compared inside bounded tasks that count intersections by an
   inverted index and give back a spanning forest only; buckets with common members are one there, and a
   component's own members don't meet again.

A pair at similarity s is missed with probability (1 - s^rows)^bands: 5e-8 at 0.8 for 32 bands of 4.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, drop_stored, hashed_words, in_bitmap, mix, row_slices, shingle_hashes, small_batches, some, stored, texts_of
from .components import components, extended

SEED = 20240607
SMALL_BUCKET = 24  # larger unfinished buckets get exact keys, then bounded tasks
TASK_MEMBERS, TASK_SHINGLES = 256, 500_000  # bounds of one side of such a task
FREQUENT, PREFIX_BITS = 8, 1 << 23  # sets that have a frequent shingle, at least; bits of the map of those (1 MB)
SLICE = 1 << 19  # bytes of text that are hashed at once
HUB_EDGES = 256  # edges of a hub that one task confirms


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence; else empty."""
    hashes, _, _, first = hashed_words(texts, lower=True)
    flat, out = shingle_hashes(hashes, n), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(flat[a : b - n + 1]) if b - a >= n else shingle_hashes(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1), rng.integers(1, 2**63, count, dtype=np.uint64)


def min_max(sets: list[np.ndarray], mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each of the non-empty sets its minimum and its maximum under each permutation: 2 values per evaluation."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, v = np.empty((2 * len(mul), len(sets)), np.uint64), np.empty_like(flat)
    for k in range(len(mul)):
        np.multiply(flat, mul[k], out=v)
        np.add(v, add[k], out=v)
        out[k] = np.minimum.reduceat(v, starts)
        out[k + len(mul)] = np.maximum.reduceat(v, starts)
    return out.T


def band_columns(bands: int, rows: int) -> np.ndarray:
    """Signature columns of each band: every value serves once, minima and maxima alternate.

    Columns k and k + half are the minimum and maximum of permutation k. The bands go over the
    permutations twice, the second time with the other kind of each; a band never takes both of one."""
    half = (bands * rows + 1) // 2
    at = np.arange(bands * rows).reshape(bands, rows)
    return at % half + half * ((at % half + at // half) % 2)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (sets x bands) from the values that band_columns deals to each band."""
    pick = band_columns(bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        out = mix(out + signatures[:, pick[:, r]])
    return out.view(np.int64)


def _lists(keys: np.ndarray, held: np.ndarray) -> pa.Array:
    """Rows of keys as lists; rows that held denies have empty ones."""
    offsets = np.concatenate([[0], np.cumsum(held * keys.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (digest of the whole set, null for an empty one), keys (one per band)."""
    half = (bands * rows + 1) // 2

    def run(batches):
        mul, add = permutations(half)
        for batch in batches:
            texts = texts_of(batch.column(2))
            for lo, hi in row_slices(texts, SLICE):
                sets = shingle_sets(texts.slice(lo, hi - lo), shingle)
                full = [s for s in sets if len(s)]
                keys = band_keys(min_max(full, mul, add), bands, rows) if full else np.zeros((0, bands), np.int64)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(sizes), pa.array(digests, pa.binary()), _lists(keys, sizes > 0)],
                    ["doc_id", "text_hash", "n_shingles", "set_key", "keys"],
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, keys array<long>")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(rep, shingles) of docs (rep, text); neighbouring rows of one rep are repeats of one text and count once."""

    def run(batches):
        last = None
        for batch in batches:
            texts, reps = texts_of(batch.column(1)), batch.column(0).to_numpy()
            for lo, hi in row_slices(texts, SLICE):
                blobs = [s.tobytes() for s in shingle_sets(texts.slice(lo, hi - lo), shingle)]
                fresh = np.concatenate([[reps[lo] != last], reps[lo + 1 : hi] != reps[lo : hi - 1]])
                last = reps[hi - 1]
                yield pa.RecordBatch.from_arrays([pa.array(reps[lo:hi]), pa.array(blobs, pa.binary())], ["rep", "shingles"]).filter(pa.array(fresh))

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """A bitmap of the shingles that more than FREQUENT of the sets have."""

    def run(batches):
        for batch in batches:
            flat = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]) if batch.num_rows else np.zeros(0, np.uint64)
            token, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    counted = sets.select("rep", "shingles").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return bitmap_of(counted.where(F.col("n") > FREQUENT), "token", PREFIX_BITS)


def prefix_keys(sets: DataFrame, percent: int, frequent) -> DataFrame:
    """(rep, n, keys): the first shingles of each set in an order that all sets share, those that few sets have first. Two
    sets that reach the similarity have one of them in common, for a set can miss only as many as the others are."""

    def run(batches):
        for batch in batches:
            keys, sizes = [np.zeros(0, np.uint64)], []
            for x in batch.column(1):
                got = np.frombuffer(x.as_buffer(), np.uint64)
                often = in_bitmap(frequent.value, got)
                first = len(got) - (percent * len(got) + 99) // 100 + 1
                keys.append(np.concatenate([got[~often], got[often]])[:first])
                sizes.append(len(got))
            ends = np.cumsum([len(k) for k in keys]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists], ["rep", "n", "keys"])

    return sets.select("rep", "shingles").mapInArrow(run, "rep long, n long, keys array<long>")


STAR = "key long, hub long, rep long, n long, border boolean"


def stars(keyed: DataFrame) -> DataFrame:
    """(key, hub, rep, n, border) of (rep, n, key): the members of each bucket with their hub, the smallest one.

    Rows are dealt by ranges of (key, rep), so that even a bucket that holds a third of all rows is shared among
    tasks; a bucket that ranges cut has a hub in each. Border rows name the hubs of each range's first and last
    bucket, whether it has other members or not; ``members_of`` joins those of one bucket."""

    def run(batches):
        def rows(key, hub, rep, n, border):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, hub, rep, n)] + [pa.array([border] * len(key), pa.bool_())], STAR_NAMES)

        key = hub = hub_n = None
        told = True  # whether the last bucket's hub has been given as a member
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, reps, ns = (batch.column(k).to_numpy() for k in range(3))
            if key is None:
                yield rows(keys[:1], reps[:1], reps[:1], ns[:1], True)
            begins = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            at = np.flatnonzero(begins)
            go_on = int(at[0]) if len(at) else len(keys)  # rows of the bucket before
            if go_on:
                if not told:
                    yield rows([key], [hub], [hub], [hub_n], False)
                    told = True
                yield rows(keys[:go_on], np.full(go_on, hub), reps[:go_on], ns[:go_on], False)
            if len(at):
                group = np.cumsum(begins[go_on:]) - 1
                size = np.bincount(group)
                held = np.flatnonzero(size[group] > 1)
                yield rows(keys[go_on:][held], reps[at][group[held]], reps[go_on:][held], ns[go_on:][held], False)
                key, hub, hub_n, told = keys[at[-1]], reps[at[-1]], ns[at[-1]], bool(size[-1] > 1)
        if key is not None:
            yield rows([key], [hub], [hub], [hub_n], True)

    return keyed.select("key", "rep", "n").repartitionByRange("key", "rep").sortWithinPartitions("key", "rep").mapInArrow(run, STAR)


STAR_NAMES = ["key", "hub", "rep", "n", "border"]


def members_of(star: DataFrame) -> DataFrame:
    """(key, hub, rep, n): members of all buckets of several; the hubs of a cut bucket have its smallest as their hub."""
    border = star.where("border").select("key", "rep", "n").distinct()
    cut = border.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("hubs")).where("hubs > 1").select("key", "hub")
    return star.where("not border").select("key", "hub", "rep", "n").unionByName(border.join(cut, "key").select("key", "hub", "rep", "n"))


def star_edges(members: DataFrame) -> DataFrame:
    return members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def linked(common: np.ndarray | int, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


def confirm(edges: DataFrame, sets: DataFrame, percent: int, chunk: int | None = None) -> DataFrame:
    """Those of the edges (a, b) whose full sets reach the similarity.

    The sets of the many b travel to their a; a hub's edges are dealt to several tasks, each with a copy
    of the hub's set. Rows stream in order, a task holds one hub's set and one batch."""
    chunk = chunk or HUB_EDGES
    many = edges.groupBy("a").agg((F.count("*") / chunk).cast("int").alias("last"))
    dealt = edges.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("part"))
    hubs = dealt.select(F.col("a").alias("x"), "a", "part", F.lit(0).alias("kind")).distinct()
    asked = hubs.unionByName(dealt.select(F.col("b").alias("x"), "a", "part", F.lit(1).alias("kind")))
    rows = asked.join(sets, F.col("x") == F.col("rep")).select("a", "part", "kind", F.col("x").alias("b"), "shingles")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind")

    def run(batches):
        at, hub = None, None
        for batch in batches:
            out_a, out_b = [], []
            a, part, kind, b = (batch.column(k).to_pylist() for k in range(4))
            for k, blob in enumerate(batch.column(4)):
                got = np.frombuffer(blob.as_buffer(), np.uint64)
                if kind[k] == 0:
                    at, hub = (a[k], part[k]), got.copy()  # it outlives the batch
                elif at == (a[k], part[k]) and linked(min(len(hub), len(got)), len(hub), len(got), percent):
                    if linked(len(np.intersect1d(hub, got, assume_unique=True)), len(hub), len(got), percent):
                        out_a.append(a[k])
                        out_b.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def open_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, rep, n, root, size) of the members of buckets that lie in several components. The file of label is far smaller than its
    rows in memory: the join sorts both sides, as a broadcast would go through the driver."""
    placed = members.join(label.hint("merge"), members.rep == label.node, "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    still = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
    return placed.join(still, "key")


def pairs_across(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of each bucket that lie in different components and whose sizes allow the similarity."""
    x = rest.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    y = rest.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return x.join(y.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits).select("a", "b").distinct()


def _forest(ids: list, side: list, roots: list, sets: list, percent: int):
    """Links between members of different roots (and, if two sides are given, of different sides) that suffice to join them."""
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    sizes = np.array([len(s) for s in sets])
    token, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[first, len(token)])
    place = np.repeat(np.arange(len(first)), length)  # posting list of each entry
    own = np.empty(len(token), np.int64)
    own[order] = place  # entries in member order again
    ends = np.cumsum(sizes)
    for x in range(len(sets)):
        if side[x] == 2:  # met from side 1
            continue
        mine = own[ends[x] - sizes[x] : ends[x]]
        mine = mine[length[mine] > 1]
        if not len(mine):
            continue
        n = length[mine]
        at = np.repeat(first[mine] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        common = np.bincount(member[at], minlength=len(sets))
        for y in np.flatnonzero(linked(common, sizes, sizes[x], percent)):
            if (side[y] == 2 or side[x] == 0 and y > x) and find(roots[x]) != find(roots[y]):
                top[find(roots[x])] = find(roots[y])
                yield ids[x], ids[y]


def merged_buckets(rest: DataFrame) -> DataFrame:
    """(key, rep, n, root): rest with the buckets that hang together by common members joined into one, where that gives
    fewer pairs: texts that share much meet in a bucket for each shingle they share, and one comparison is enough."""
    size = stored(rest.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").cast("double").alias("size")))
    drawn = stored(rest.join(size.hint("merge"), "key").select("hub", "rep").distinct())
    group = components(drawn, "hub", "rep").withColumnRenamed("root", "group")
    each = size.join(group.hint("merge"), size.hub == group.node).select("key", "size", "group")
    pairs = each.groupBy("group").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    members = rest.select("rep", "n", "root").distinct().join(group.hint("merge"), F.col("rep") == F.col("node")).select("group", "rep", "n", "root")
    whole = members.groupBy("group").agg(F.count("*").cast("double").alias("all")).join(pairs.hint("merge"), "group")
    whole = stored(whole.select("group", (F.col("all") * F.col("all") <= F.col("pairs")).alias("merge")))
    joined = members.join(whole.where("merge").hint("merge"), "group").select(F.col("group").alias("key"), "rep", "n", "root")
    apart = each.join(whole.where("not merge").hint("merge"), "group").select("key")
    out = stored(joined.unionByName(rest.join(apart.hint("merge"), "key").select("key", "rep", "n", "root")))
    drop_stored(size, drawn, group, whole)
    return out


def block_tasks(rest: DataFrame) -> DataFrame:
    """(key, rep, root, i, j, side): the members of each bucket (key, rep, n, root), dealt into blocks of bounded size, once
    for each pair of blocks to compare. A component that fills blocks gets its own, which don't meet each other."""
    fill = F.greatest(F.count("*") / TASK_MEMBERS, F.sum("n") / TASK_SHINGLES)
    large = rest.groupBy("key", "root").agg(fill.alias("fill")).where("fill >= 1").select("key", "root", F.col("root").alias("own"))
    placed = stored(rest.join(large.hint("merge"), ["key", "root"], "left").select("key", "rep", "n", "root", "own"))
    blocks = placed.groupBy("key", "own").agg(F.ceil(fill).cast("int").alias("own_blocks"))
    order = Window.partitionBy("key").orderBy(F.col("own").asc_nulls_first())  # a row for each component with blocks of its own
    last = F.sum("own_blocks").over(order).cast("int")
    total = F.sum("own_blocks").over(Window.partitionBy("key")).cast("int")
    blocks = blocks.select(F.col("key").alias("of"), F.col("own").alias("by"), "own_blocks", (last - F.col("own_blocks")).alias("first"), total.alias("blocks"))
    known = placed.join(blocks.hint("merge"), (F.col("key") == F.col("of")) & F.col("own").eqNullSafe(F.col("by")))
    block = F.col("first") + F.pmod(F.xxhash64("rep"), F.col("own_blocks")).cast("int")
    dealt = stored(known.select("key", "rep", "root", "own", "first", "own_blocks", "blocks", block.alias("block")))
    drop_stored(placed)
    spread = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.where(F.col("own").isNull() | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("own_blocks")))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    # a block meets itself in task (i, i) only; side 0 compares all, sides 1 and 2 only each other
    return spread.select("key", "rep", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"))


def confirm_large(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the components met in large unfinished buckets (key, rep, n, root).

    Buckets that hang together become one; its members are dealt into blocks; a task compares two blocks, so its size
    is bounded. Members are written with their block before they are copied for each task, so a bucket's copies come
    from many tasks. How often a row is copied isn't in Spark's estimate of sizes: both sides are sorted, for as a
    broadcast the copies would go through the driver."""
    dealt = block_tasks(merged_buckets(rest))
    rows = dealt.join(sets.hint("merge"), "rep").select("key", "i", "j", "rep", "root", "side", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def run(batches):
        def done(group):
            ids, roots, side, blobs = zip(*group)
            pairs = list(_forest(ids, side, roots, [np.frombuffer(x, np.uint64) for x in blobs], percent))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        at, group = None, []
        for batch in batches:
            for key, i, j, rep, root, side, blob in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if (key, i, j) != at:
                    if len({g[1] for g in group}) > 1:
                        yield done(group)
                    at, group = (key, i, j), []
                group.append((rep, root, side, blob))
        if len({g[1] for g in group}) > 1:
            yield done(group)

    return rows.mapInArrow(run, "a long, b long")


def _nodes(sig: DataFrame) -> tuple[DataFrame, bool]:
    """sig with node, the number of a document's set in the graph: its doc_id; where rows share a doc_id and have
    different sets, negative numbers tell them apart (second result: whether there are such)."""
    several = sig.where("doc_id is not null and set_key is not null").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi")
    if not some(several):
        return sig.withColumn("node", F.col("doc_id")), False
    several = stored(several.select("doc_id"))
    other = sig.join(several.withColumn("shared", F.lit(True)), "doc_id", "left")
    return other.withColumn("node", F.when(F.col("shared"), -1 - F.shiftright(F.abs(F.xxhash64("doc_id", "set_key")), 1)).otherwise(F.col("doc_id"))).drop("shared"), True


def _extend(label: DataFrame | None, links: DataFrame) -> DataFrame:
    out = extended(label, links, "a", "b")
    drop_stored(links, None if out is label else label)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, exact_keys: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text), root (tells components apart, also where
    ids are shared; null without a set or an id): one row for each row of docs.

    Words are runs without ASCII white space, A-Z lower-cased. Two documents are linked if
    100 * |A & B| >= percent * |A | B| over their whole shingle sets; component_id is the smallest doc_id
    reachable by links. Null and wordless texts have an empty set and are linked with nothing; a null
    doc_id is returned unlinked (component_id null, kept); repeated rows share one decision; rows that share a
    doc_id but not the text are compared each by its own text. Texts may be of any length; a set is held whole by
    one task at a time. An empty table gives an empty one; other columns are ignored, whatever their names.
    exact_keys: whether members of large unfinished buckets get keys from their sets before they are compared in tasks.
    """
    spark = small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    raw = stored(signatures(docs, shingle, bands, rows))
    sig, shared = _nodes(raw)
    reps = stored(
        sig.where("node is not null and set_key is not null").groupBy("set_key")
        .agg(F.min("node").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.min_by(F.struct("doc_id", "text_hash"), "node").alias("row"))
    )
    keyed, sets, label, over = reps.select("rep", "n", F.explode("keys").alias("key")), None, None, []
    while keyed is not None:
        star = stored(stars(keyed))
        members = stored(members_of(star))
        drop_stored(star)
        if not some(members):
            drop_stored(members)
            break
        if sets is None:
            involved = members.select("rep").distinct().join(reps, "rep").select(F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"), "rep")
            sets = stored(sets_of(docs.join(involved, ["doc_id", "text_hash"]), shingle), "none")
        links = stored(confirm(star_edges(members), sets, percent))
        label = _extend(label, links)
        rest = stored(open_buckets(members, label))
        large, keyed = rest.where(F.col("size") > SMALL_BUCKET), None
        more = pairs_across(rest.where(F.col("size") <= SMALL_BUCKET), percent).join(star_edges(members), ["a", "b"], "left_anti")
        more = confirm(more, sets, percent)
        if some(large):
            if exact_keys and not over:
                over.append(stored(sets.join(large.select("rep").distinct(), "rep", "left_semi"), "none"))
                frequent = spark.sparkContext.broadcast(frequent_shingles(over[0]))
                over.append(stored(prefix_keys(over[0], percent, frequent)))
                keyed = over[1].select("rep", "n", F.explode("keys").alias("key"))
            else:
                more = more.union(confirm_large(large, sets, percent))
        if some(rest):
            links = stored(more)
            label = _extend(label, links)
        drop_stored(rest, members)
    if label is None:
        root = reps.withColumn("root", F.lit(None).cast("long"))
    else:
        root = reps.join(label.hint("merge"), reps.rep == label.node, "left")
    grouped = (F.col("root").isNotNull() | (F.col("copies") > 1)).alias("grouped")
    root = root.select("set_key", "low", F.coalesce("root", "rep").alias("root"), grouped)
    if shared:
        root = root.join(root.groupBy("root").agg(F.min("low").alias("component")), "root")
    else:
        root = root.withColumn("component", F.col("root"))
    known = sig.select("doc_id", "n_shingles", "set_key", "text_hash", "node")
    out = known.join(root.where("grouped").select("set_key", "component", "root"), "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    own = F.when(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull(), F.coalesce("root", "node"))
    out = stored(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash", own.alias("root")))
    drop_stored(raw, reps, sets, label, *over)
    return out
