"""The trie of conversation prefixes, by partition refinement.

All sequences start in one class, the root. Turn by turn a class is split by its members' next turn; what is alone
in its class retires at once, its tail a chain of nodes with one child each; at last counts are folded back from the
deepest level to the root. Equal sequences are one member with a weight, so copies of any length and number retire
together. Classes of few turns are refined to their ends where they lie, one class in a task's memory; larger ones
level by level across the cluster, where a class is only its key in aggregations that combine before they shuffle.

A class is known by its depth and its smallest id. A turn is its digest (SHA-256 of role and text) and its size.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, some, stored

#: Turns of a class that is refined in one task.
SMALL_CLASS = 50_000
#: Characters of ids hashed from one row; longer lists come as several rows in order.
CHUNK = 1 << 20
TURNS = "array<struct<turn:long,digest:binary,size:long>>"
NODE = "id long, depth long, parent_id long, n_members long, n_children long, n_leaves long, saved long, ends_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame) -> DataFrame:
    """id, seq (TURNS): the turns of each conv_id in order: by turn, null first, then digest; null role and text are empty.

    Rows without conv_id belong to no conversation. A conversation's digests are one row; its texts are not moved."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    one = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("id"), one.alias("t"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).cast(TURNS).alias("seq"))


def rebuilt(lists: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each list c becomes the first h of list c - c % every (none if absent), then its own after the first h; h = crc32(c) % most."""
    ids = lists.select("id", "seq", (F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int").alias("h"), (F.col("id") - F.col("id") % every).alias("from_id"))
    heads = lists.where(F.col("id") % every == 0).select(F.col("id").alias("head_id"), F.slice("seq", 1, most - 1).alias("head"))
    joined = ids.join(heads, F.col("from_id") == F.col("head_id"), "left")
    head = F.slice(F.coalesce("head", F.array().cast(TURNS)), F.lit(1), F.col("h"))
    return joined.select("id", F.concat(head, F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))).alias("seq"))


def _hash_of_ids(members: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of each key's ids, ascending, comma-joined, over (key, id).

    Rows are dealt by ranges of (key, id), so that a large key is written as text by many tasks; its pieces then
    stream through one, for that hash can't be put together from parts."""
    small_batches(members.sparkSession)
    dealt = members.select("key", "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")

    def chunks(batches):
        at, first, out, size = None, None, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(out)], pa.string())], ["key", "first", "ids"])

        for batch in batches:
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out and (key != at or size > CHUNK):
                    yield piece()
                    out, size = [], 0
                if not out:
                    at, first = key, i
                out.append(str(i))
                size += len(out[-1]) + 1
        if out:
            yield piece()

    pieces = dealt.mapInArrow(chunks, "key binary, first long, ids string")

    def hashed(batches):
        at, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != at:
                    if state is not None:
                        yield row()
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield row()

    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends string")


def distinct_sequences(lists: DataFrame) -> DataFrame:
    """id (smallest), weight, ends, seq: equal sequences once. ends: hash of all their ids."""
    keyed = stored(lists.select("id", "seq", F.unhex(F.sha2(F.array_join(F.transform("seq", lambda t: F.hex(t["digest"])), ""), 256)).alias("key")))
    counted = stored(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("weight")))
    copies = counted.where("weight > 1").select(F.col("key").alias("many"))
    hashes = stored(_hash_of_ids(keyed.join(copies, F.col("key") == F.col("many"), "left_semi")).withColumnRenamed("key", "many"))
    firsts = keyed.join(counted.drop("key"), F.col("id") == F.col("first")).join(hashes, F.col("key") == F.col("many"), "left")
    out = stored(firsts.select("id", "weight", F.coalesce("ends", F.sha2(F.col("id").cast("string"), 256)).alias("ends"), "seq"))
    drop_stored(keyed, counted, hashes)
    return out


def _chain(depth: Column) -> Column:
    """The nodes of a retired member (id, ends, rest) without copies, whose first one is at depth: rest holds its turns from there on."""
    n = F.size("rest")

    def node(_, k):
        parent = F.when(k == 0, F.col("parent_id")).otherwise(F.col("id"))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        parts = {"id": F.col("id"), "depth": depth + k, "parent_id": parent, "n_members": one, "n_children": F.when(k == n - 1, none).otherwise(one), "n_leaves": one, "saved": none, "ends_sha256": F.when(k == n - 1, F.col("ends")).otherwise(EMPTY)}
        return F.struct(*(v.alias(c) for c, v in parts.items()))

    return F.explode(F.transform("rest", node))


def _nodes_of_class(depth: int, parent: int, members: list[tuple]) -> list[tuple]:
    """All nodes below a class at depth, as rows of NODE. members: (id, weight, ends, [(digest, size), ...] from depth on)."""
    out: list[list] = []
    work = [(depth, parent, -1, members)]
    while work:  # refinement, a class at a time; -1: the class itself, whose node isn't ours
        d, above, up, rows = work.pop()
        split: dict[bytes, list] = {}
        for r in rows:
            if len(r[3]) > d - depth:
                split.setdefault(r[3][d - depth][0], []).append(r)
        for part in split.values():
            low = min(r[0] for r in part)
            if len(part) == 1:  # retired: its tail at once
                one = part[0]
                for k in range(d - depth, len(one[3])):
                    end = k == len(one[3]) - 1
                    out.append([low, depth + k + 1, above if k == d - depth else low, one[1], 0, 0, (one[1] - 1) * one[3][k][1], one[2] if end else EMPTY, up if k == d - depth else len(out) - 1])
                continue
            ends = next((r[2] for r in part if len(r[3]) == d - depth + 1), EMPTY)
            n = sum(r[1] for r in part)
            out.append([low, d + 1, above, n, 0, 0, (n - 1) * part[0][3][d - depth][1], ends, up])
            work.append((d + 1, low, len(out) - 1, part))
    for node in reversed(out):  # folded back: children stand behind their parents
        node[5] = node[5] or 1
        if node[8] >= 0:
            top = out[node[8]]
            top[4] += 1
            top[5] += node[5]
            top[6] += node[6]
    return [tuple(n[:8]) for n in out]


def _refined(members: DataFrame, depth: int, alone: bool) -> DataFrame:
    """The nodes below classes that fit a task: members (class, id, weight, ends, rest). alone: each member is a class."""
    names = [x.split() for x in NODE.split(", ")]
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in names])
    rest = F.transform("rest", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    dealt = members.select("class", "id", "weight", "ends", rest.alias("rest"))
    if not alone:
        dealt = dealt.repartition("class").sortWithinPartitions("class", "id")

    def told(at, held):
        rows = _nodes_of_class(depth, at, held)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        at, held = None, []
        for batch in batches:
            for c, i, weight, ends, rest in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and (alone or c != at):
                    yield told(at, held)
                    held = []
                at = c
                held.append((i, weight, ends, [(t["digest"], t["size"]) for t in rest]))
        if held:
            yield told(at, held)

    return dealt.mapInArrow(run, NODE)


def trie_nodes(lists: DataFrame, small_class: int = SMALL_CLASS) -> DataFrame:
    """The nodes (NODE) of the trie of all lists (id, seq): id is the smallest member, saved the sum over the subtree of
    (n_members - 1) times the size of a node's last turn, ends_sha256 the hash of the ids that end in the node.

    Lists without turns are members of the root; no lists give no nodes. ids must be unique and not null. Cluster-wide
    levels go on only while a class has more than small_class turns left; each is one aggregation and one join."""
    small_batches(lists.sparkSession)
    members = distinct_sequences(lists)
    root = stored(members.agg(F.min("id").alias("id"), F.sum("weight").alias("n_members"), F.max(F.when(F.size("seq") == 0, F.col("ends"))).alias("ends")).where("id is not null"))
    top = root.first()
    active = members.where("size(seq) > 0").select(F.lit(top["id"] if top else None).cast("long").alias("class"), "id", "weight", "ends", F.col("seq").alias("rest"))
    found, levels, held = [], [root.select("id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_id"), "n_members", F.lit(0).cast("long").alias("size"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"))], [members, root]
    depth = 0
    while True:
        turn = F.get("rest", F.lit(0))
        rows = active.withColumns({"digest": turn["digest"], "size": turn["size"]})
        ended = F.max(F.when(F.size("rest") == 1, F.col("ends")))
        left = F.sum((F.size("rest") - 1).cast("long"))
        split = rows.groupBy("class", "digest").agg(F.min("id").alias("next"), F.sum("weight").alias("n_members"), F.count("*").alias("n"), F.max("size").alias("size"), ended.alias("end"), left.alias("left"))
        split = stored(split)
        below = stored(rows.drop("size").join(split.select(F.col("class").alias("c"), F.col("digest").alias("g"), "next", "n", "left"), (F.col("class") == F.col("c")) & (F.col("digest") == F.col("g"))).select("class", "next", "n", "left", "id", "weight", "ends", "rest"))
        held += [split, below]
        alone = below.where("n = 1")
        found.append(alone.where("weight = 1").select("id", "ends", "rest", F.col("class").alias("parent_id")).select(_chain(F.lit(depth + 1).cast("long")).alias("node")).select("node.*"))
        found.append(_refined(alone.where("weight > 1"), depth, alone=True))
        levels.append(split.where("n > 1").select(F.col("next").alias("id"), F.lit(depth + 1).cast("long").alias("depth"), F.col("class").alias("parent_id"), "n_members", "size", F.coalesce("end", F.lit(EMPTY)).alias("ends")))
        depth += 1
        more = below.where("n > 1 and size(rest) > 1").select(F.col("next").alias("class"), "id", "weight", "ends", F.slice("rest", F.lit(2), F.size("rest") - 1).alias("rest"), "left")
        found.append(_refined(more.where(F.col("left") <= small_class), depth, alone=False))
        active = more.where(F.col("left") > small_class).drop("left")
        if not some(active):
            break
    nodes = stored(reduce(DataFrame.union, found))
    kids = [nodes.where(F.col("depth") <= depth + 1)]
    for k in range(depth, -1, -1):
        children = reduce(DataFrame.union, kids).where(F.col("depth") == k + 1)
        sums = children.groupBy("parent_id").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
        own = levels[k].join(sums.withColumnRenamed("parent_id", "p"), F.col("id") == F.col("p"), "left")
        zero = F.lit(0).cast("long")
        saved = (F.col("n_members") - 1) * F.col("size") + F.coalesce("below", zero)
        own = stored(own.select("id", "depth", "parent_id", "n_members", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), saved.alias("saved"), F.col("ends").alias("ends_sha256")))
        kids = [kids[0], own]
        nodes = nodes.union(own)
    drop_stored(*held)
    return nodes


def conversation_trie(turns: DataFrame, every: int = 5, most: int = 9, small_class: int = SMALL_CLASS) -> DataFrame:
    """The trie of rebuilt conversations; see turn_lists, rebuilt and trie_nodes. turns: conv_id, turn, role, text; other
    columns are ignored. Repeated rows are repeated turns, an empty table gives an empty one."""
    lists = stored(turn_lists(turns))
    built = stored(rebuilt(lists, every, most))
    nodes = trie_nodes(built, small_class)
    drop_stored(lists, built)
    return nodes


def digest_trie(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("id").alias("conv_id"), "depth", F.col("parent_id").alias("parent_conv_id"), F.col("n_members").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )
