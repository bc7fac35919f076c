"""Corpus operators against brute-force versions on a small fixture with nulls, empty, long, tied and repeated texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeseam.llm import chat, common, decontaminate, language, licences, packing, pii, quality, substrings
from codeseam.llm.components import components
from codeseam.llm.exact_dedup import build_mph, exact_duplicates, lookup_mph
from codeseam.llm.near_dedup import near_duplicates
from codeseam.llm.queries import tokenizer_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 6))) for _ in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(80))
    texts = [None, "", " \t\n", "one", "One", "ONE two", "É", "é", "123 456", "a\x0bb\x0cc"]
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):  # near copies around the threshold
            near = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                near[r.randrange(len(near))] = r.choice(vocab)
            texts.append(" ".join(near).upper() if r.random() < 0.3 else " ".join(near))
        if r.random() < 0.4:
            texts.append(" ".join(base[:20]) + " " + passage + "\n" + " ".join(base[20:60]))
    texts += ["from " * 500, "from " * 120, texts[10], texts[10], " ".join(r.choice(vocab) for _ in range(6000))]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", 0, "clash") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept string").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_exact(docs, nothing):
    group = defaultdict(list)
    for i, t in corpus():
        group[(t or "").translate(LOW)].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in group.items() for i in g}
    for history in (None, F.lit(True), F.lit(False), F.col("doc_id") % 7 == 0):
        assert {tuple(r) for r in exact_duplicates(docs, history).drop("text_hash").collect()} == want
    assert exact_duplicates(nothing).count() == 0
    twice = docs.union(docs.where("doc_id = 30"))
    assert exact_duplicates(twice).where("doc_id = 30").count() == 2
    nulls = docs.limit(5).select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert exact_duplicates(nulls).where("kept").count() == 5


def test_perfect_hash():
    d = np.random.default_rng(1).integers(0, 2**63, (5000, 4), dtype=np.uint64)
    levels, slots = build_mph(d)
    assert sorted(slots) == list(range(5000)) and (lookup_mph(levels, d) == slots).all()


def near_brute(n, percent=80):
    sets = {}
    for i, t in corpus():
        w = WORDS.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n_common = len(sets[a] & sets[b])
            if a < b and n_common and 100 * n_common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


NEAR = ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("n", [4, 5])
def test_near(docs, nothing, n, monkeypatch):
    want = near_brute(n)
    assert len({c for _, _, c, _ in want}) < len(want)
    assert {tuple(r) for r in near_duplicates(docs, n).select(NEAR).collect()} == want
    if n == 4:
        from codeseam.llm import near_dedup

        monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 1)  # every unfinished bucket is large: exact keys first
        monkeypatch.setattr(near_dedup, "FREQUENT", 2)
        assert {tuple(r) for r in near_duplicates(docs, n).select(NEAR).collect()} == want
        monkeypatch.setattr(near_dedup, "TASK_MEMBERS", 2)  # by bounded tasks at once
        assert {tuple(r) for r in near_duplicates(docs, n, exact_keys=False).select(NEAR).collect()} == want
        assert near_duplicates(nothing, n).count() == 0


def test_large_buckets_meet_once(spark, monkeypatch):
    """Members of many buckets are compared once, those of one component not at all, and no copies go through the driver."""
    from codeseam.llm import near_dedup as nd

    monkeypatch.setattr(nd, "TASK_MEMBERS", 4)
    r = random.Random(3)
    sets = {i: sorted(r.sample(range(12), r.choice([9, 10, 11]))) for i in range(-20, 40)}
    root = {i: -20 if i < 0 else i for i in sets}  # a component of 20 members, and 40 more
    rest = [(key, i, len(sets[i]), root[i]) for i in sets for key in (range(30) if i < 30 else (30, 31))]
    rest += [(31, 29, len(sets[29]), 29), (99, 100, 9, 100), (99, 101, 9, 101)]
    sets |= {100: list(range(50, 59)), 101: list(range(50, 59)), 102: list(range(50, 59))}
    rows = [(i, np.array(s, np.uint64).tobytes()) for i, s in sets.items()]
    rest, stored = spark.createDataFrame(rest, "key long, rep long, n long, root long"), spark.createDataFrame(rows, "rep long, shingles binary")
    links = nd.confirm_large(rest, stored, 80)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    top = {i: root.get(i, i) for i in sets}

    def joined(pairs):
        of = dict(top)
        for a, b in pairs:
            x, y = of[a], of[b]
            of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
        return of

    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]}) and 102 not in (a, b)]
    got = [(x.a, x.b) for x in links.collect()]
    assert {(min(p), max(p)) for p in got} <= {*linked} and joined(got) == joined(linked) and len({*joined(got).values()}) < 40
    tasks = nd.block_tasks(nd.merged_buckets(rest)).collect()
    assert len({(x.i, x.j) for x in tasks if x.key != 99}) <= 10 * 11 // 2 + 5 * 10 and len(tasks) < 60 * 15 + 5
    assert not [x for x in tasks if x.i == x.j and x.root == -20]


def test_near_by_row(spark):
    """Rows that share a doc_id are compared by their own texts; repeats share a decision; null ids stay alone."""
    words = [f"w{k}" for k in range(60)]
    one, near, other, third = " ".join(words), " ".join([*words[:58], "x", "y"]), " ".join(words[::-1]), "a b c d e f g"
    rows = [(5, one), (5, one), (5, other), (3, near), (None, one), (None, None), (7, other), (8, third), (8, None), (9, "")]
    d = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, count long, root string")
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in near_duplicates(d).collect())
    assert got == sorted([("5", 56, "3", False)] * 2 + [("5", 56, "5", True), ("3", 56, "3", True), ("None", 56, "None", True), ("None", 0, "None", True), ("7", 56, "5", False), ("8", 3, "8", True), ("8", 0, "8", True), ("9", 0, "9", True)])


def test_stars_of_cut_buckets(spark):
    """A bucket that lies in many ranges still hangs together."""
    from codeseam.llm import near_dedup as nd

    rows = [(k, 1, 7) for k in range(4000)] + [(k, 1, 8 + k // 2) for k in range(600)] + [(k, 1, -k) for k in range(50)]
    keyed = spark.createDataFrame(rows, "rep long, n long, key long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        star = nd.stars(keyed).cache()
        members = nd.members_of(star).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.rep for r in members if r.key == 7} == set(range(4000)) and len({r.hub for r in members if r.key == 7}) > 1
    label = {r.node: r.root for r in components(spark.createDataFrame([(r.hub, r.rep) for r in members if r.key == 7 and r.hub != r.rep], "a long, b long"), "a", "b").collect()}
    assert label == dict.fromkeys(range(4000), 0)
    assert sorted((r.key, r.hub, r.rep) for r in members if r.key >= 8) == sorted((8 + k // 2, k // 2 * 2, k) for k in range(600))
    assert not [r for r in members if r.key <= 0]
    alone = nd.stars(spark.createDataFrame([(k, 1, k) for k in range(300)], "rep long, n long, key long"))
    assert alone.where("not border").count() == 0 and nd.members_of(alone).count() == 0


def test_components(spark):
    r = random.Random(2)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    top = {x: x for p in e for x in p}
    for _ in range(len(top)):
        for a, b in e:
            top[a] = top[b] = min(top[a], top[b])
    got = dict(map(tuple, components(spark.createDataFrame(e, "x long, y long"), "x", "y").collect()))
    assert got == {k: v for k, v in top.items() if k in got} and all(top[k] == k for k in top if k not in got)


@pytest.mark.parametrize("most", [7, 1000])
def test_components_in_tasks(spark, monkeypatch, most):
    """Few edges are joined by two tables and a few jobs, however long their chains; more of them by rounds, with the same result."""
    from codeseam.llm import components as c

    monkeypatch.setattr(c, "TASK_EDGES", most)
    r = random.Random(5)
    e = [(k, k + 1) for k in range(-100, 0)] + [(50, 200 - k) for k in range(30)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    r.shuffle(e)
    want = dict.fromkeys(range(-100, 1), -100) | dict.fromkeys([50, *range(171, 201)], 50) | {300: 300, 301: 300}
    edges = spark.createDataFrame(e, "x long, y long").repartition(3)
    spark.sparkContext.setJobGroup(f"components-{most}", "")
    try:
        got = components(edges, "x", "y")
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{most}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert (jobs <= 8) == (most == 1000)
    more = spark.createDataFrame([(-50, 190), (400, 301), (500, 501)], "x long, y long")
    want = {k: -100 if v == 50 else v for k, v in want.items()} | {400: 300, 500: 500, 501: 500}
    assert sorted(map(tuple, c.extended(got, more, "x", "y").collect())) == sorted(want.items())
    assert components(edges.where("x > 1000"), "x", "y").count() == 0


def substrings_brute(rows, window=50):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, w in words:
        drop = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                drop[k : k + window] = [True] * window
        want.append((repr(i), len(w), sum(drop), " ".join(x for x, d in zip(w, drop) if not d)))
    return sorted(want)


def substrings_of(d):
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(d).collect())


def test_substrings(docs, nothing, monkeypatch):
    want = substrings_brute(corpus())
    assert sum(x[2] for x in want) > 500
    assert substrings_of(docs) == want
    assert substrings.dedup_substrings(nothing).count() == 0
    monkeypatch.setattr(substrings, "MOST_ANCHORS", 0)  # anchors are joined to documents
    monkeypatch.setattr(substrings, "HOT_STRETCHES", 1)  # windows row by row
    monkeypatch.setattr(substrings, "SHARD_STRETCHES", 3)
    assert substrings_of(docs) == want


def test_substrings_by_row(spark):
    """Rows that share a doc_id lose only windows of their own text; null ids lose nothing; repeats are repeated."""
    w = [f"w{k}" for k in range(160)]
    rows = [(1, " ".join(w[:70])), (2, " ".join(["x", *w[:60], "y"])), (2, " ".join(w[80:160])), (2, " ".join(w[80:160])), (None, " ".join(w[:70])), (3, " ".join(w[75:150])), (4, None), (4, ""), (5, " ".join(["a"] * 200)), (6, " ".join(["a"] * 120 + w[:20]))]
    d = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, runs string")
    assert substrings_of(d) == substrings_brute(rows)


def test_decontamination(spark, docs, nothing, monkeypatch):
    rows = corpus()
    texts = [t for _, t in rows if t and len(t) > 200]
    items = [(1, texts[3][10:200]), (2, texts[3][10:200]), (30, "Ááá!b,c"), (4, "one"), (5, None), (6, "--"), (7, texts[8][:150] + " x " + texts[9][:90])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = set()
    for i, t in rows:
        w, hit, found = pattern.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        want.add((i, len(w), len(hit), len(found), decontaminate.digest_items(found), bool(hit)))
    got = decontaminate.digest_contamination(decontaminate.contamination(docs, bench))
    assert {tuple(r) for r in got.collect()} == want and sum(x[5] for x in want) > 3
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", 150)  # several shards
    got = decontaminate.contamination(docs, bench).select("doc_id", F.size("items").alias("n")).distinct()
    assert {(r.doc_id, r.n) for r in got.collect()} == {(x[0], x[3]) for x in want}
    kept = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {x[0] for x in want if not x[5]} and kept.columns == docs.columns
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.cut_words("Aa, bb CC-dd e", [(1, 3)]) == "Aa, -dd e"


def test_decontamination_in_shards(spark, docs, monkeypatch):
    w = [f"w{k}" for k in range(400)]
    text = " ".join(w)
    bench = spark.createDataFrame([(k, " ".join(w[20 * k : 20 * k + 24])) for k in range(0, 16, 4)] + [(99, " ".join(w[90:120]))], "item_id long, text string")
    rows = [(None, text), (None, text), (None, " ".join(w[::-1])), (7, text), (7, " ".join(w[:399]) + " x"), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        return sorted((repr(r.doc_id), r.n_words, [tuple(s) for s in r.spans], r.items) for r in decontaminate.contamination(d, bench).collect())

    def kept(coverage, span=None):
        return sorted((repr(r.doc_id), r.text or "") for r in decontaminate.decontaminate(d, bench, max_coverage=coverage, max_span=span).collect())

    limits = [(0.0,), (0.2,), (0.3,), (0.5,), (0.5, 30)]
    one = found(), [kept(*x) for x in limits]
    assert len(one[0]) == 6 and [len(x) for x in one[1]] == [2, 2, 6, 6, 2]
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", 150)
    assert (found(), [kept(*x) for x in limits]) == one


def test_pii(spark, nothing):
    texts = [None, "", "call +1 (555) 010-9999 or x@y.co.uk, a@b.c@d.e", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "ip 1.2.3.4.5.6.7.8 999.1.1.1 010.000.0255.1", "é😀 u%x@h.de 12345678901234567890123", "IBAN DE89 3704 0044 0532 0130 00 konto, DE89370400440532013001", "7" * 30000 + " " + "1 " * 20000 + "a" * 30000 + "@", "4 1 1 1-1111 1111 1111 1 +123456789+12 345 678 90", "x@y.z" * 300]

    def luhn(d):
        return sum((int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10))) for k, c in enumerate(reversed(d))) % 10 == 0

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest_pii(pii.find_pii(d)).collect()}
    for i, t in enumerate(texts):
        if t and len(t) > 50000:
            continue  # quadratic for the plain patterns; it must only end
        out = []
        for k, (kind, p) in enumerate(kinds):
            for m in re.finditer(p, t or ""):
                n = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]:
                    out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        assert got[i].base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(out)).encode()).hexdigest(), (t, out, got[i])
    assert got[6].spans == "iban:5:32"
    red = pii.redact(pii.find_pii(d.where("doc_id = 2"))).first().text
    assert "[PHONE]" in red and "[EMAIL]" in red and "555" not in red
    assert pii.find_pii(nothing).count() == 0


def test_chat(spark):
    marks = ["<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]", "\\", "<", "|", "ok ", "\n", "é"]
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice(marks) for _ in range(r.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not re.search(r"<\||</?s>|\[/?INST\]", e)
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (None, 0, "user", "x"), (2, None, "assistant", "<|end|>"), (2, None, "assistant", "<|end|>"), (2, 3, None, "")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest_chat(chat.format_chat(d)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb</s>\n").hexdigest() and got[1].loss_sha256 == hashlib.sha256(b"b</s>").hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (3, 14) and got[None].n_turns == 1
    part = [("text", "see ", None, None, None, None, None), ("image", None, "u", 28, 15, None, None), ("audio", None, "v", None, None, 2.0, None)]
    parts = spark.createDataFrame([(1, 0, "user", "unused", part)], f"conv_id long, turn long, role string, text string, parts {chat.PART_TYPE}")
    s = chat.format_chat(parts).first()
    assert "see <|image:0|><|audio:1|>" in s.segment and [a.tokens for a in s.attachments] == [4, 50]
    assert chat.digest_chat(chat.format_chat(d.limit(0))).count() == 0


def test_language(spark, nothing):
    r = random.Random(1)
    syllables = {"xx": ["ka", "lo", "mi"], "yy": ["thr", "ing", "ou"]}
    rows = [(i, " ".join("".join(r.choice(syllables[x]) for _ in range(3)) for _ in range(30)), x) for i, x in enumerate(["xx", "yy"] * 40)]
    d = spark.createDataFrame(rows + [(900, None, "xx"), (901, "12 ..", None), (902, "", "yy")], "doc_id long, text string, lang string")
    model = language.train(d.where("doc_id % 2 = 0 or doc_id % 5 = 0"))
    got = {x.doc_id: x for x in language.identify(d, model).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows) == 80 and {got[k].lang_pred for k in (900, 901, 902)} == {"und"}
    mixed = spark.createDataFrame([(1, rows[0][1] + " " + rows[1][1])], "doc_id long, text string")
    assert {m.lang for m in language.identify(mixed, model).first().mixture} == {"xx", "yy"}
    assert language.identify(d, ([], np.zeros((0, 1)))).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, docs, nothing):
    r = random.Random(4)
    good = [" ".join(r.choice(["the", "house", "is", "green", "and"]) for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(r.choice(["%%%", "$$x", "|", "a###"]) for _ in range(60)) for _ in range(150)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + [None, ""])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (7777, 0), (3, None)], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality.quality_scores(d, quality.not_held_out(labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i < 150) for i in held) >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values())
    kept = {x.doc_id for x in quality.keep_good(d, quality.not_held_out(labels)).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.5}
    assert quality.quality_scores(docs, quality.not_held_out(labels.limit(0))).select("score").distinct().first().score == 0.5
    assert quality.keep_good(nothing, quality.not_held_out(labels)).count() == 0


def test_packing(docs, nothing):
    import public_tokenizers  # noqa: F401
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = set()
    for i, t in corpus():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want |= {(i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    got = packing.best_fit_packing(docs, tokenizer_path()).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= sum(r.length for r in got) / 4096 * 1.1 + 1
    assert packing.best_fit_packing(nothing, tokenizer_path()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_capacities(rule):
    n = np.random.default_rng(3).integers(1, 1000, 3000)
    b, o = packing.vector_best_fit(n, 1000, 3, 600_000, rule)
    load, docs = np.bincount(b, n), np.bincount(b)
    assert load.max() <= 1000 and docs.max() <= 3
    big = n * n <= 600_000
    assert (np.bincount(b[big], (n * n)[big].astype(float)) <= 600_000).all()


def test_every_language_is_learned(spark, monkeypatch):
    r = random.Random(3)
    vocab = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(300)}
    rows = [(lang, " ".join(r.choice(v) for _ in range(60))) for lang, v in vocab.items() for _ in range(2 if lang < "l256" else 1)]
    train = spark.createDataFrame([*rows, (None, "zz zz")], "lang string, text string")
    d = spark.createDataFrame([(k, " ".join(v * 3)) for k, v in enumerate(vocab.values())] + [(300, " ".join(vocab["l001"] + vocab["l299"]))], "doc_id long, text string")

    def found(model):
        return {x.doc_id: (x.lang_pred, round(x.score, 6), [(m.lang, round(m.share, 6)) for m in x.mixture]) for x in language.identify(d, model).collect()}

    _, shards = model = language.train(train)
    got = found(model)
    raw = language.normalised(" ".join(vocab["l001"] + vocab["l299"]))
    one = language.mixture(raw, shards)
    monkeypatch.setattr(language, "KEPT_CELLS", 0)  # scores are computed anew
    assert len(shards) == 2 and (language.mixture(raw, shards) == one).all()
    assert [got[k][0] for k in range(300)] == list(vocab) and {m[0] for m in got[300][2]} == {"l001", "l299"}
    monkeypatch.setattr(language, "SHARD_LANGUAGES", 1000)  # one shard
    names, shards = language.train(train)
    assert len(shards) == 1 and found((names, shards)) == got


def test_licences(spark, nothing):
    texts = ["a house\nReleased under the MIT License.\nmore", "x " * 300 + "licensed under the Apache Licence, version 2.0. And " + "y " * 300, "permission slip for the school trip", None, "", "Licensed under CC BY-NC 4.0.\n\nReleased under the MIT License."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.licence) for r in licences.scan_licences(d).collect()}
    assert got == {(0, "MIT"), (1, "Apache-2.0"), (5, "CC-BY-NC-4.0"), (5, "MIT")}
    rows = {r.doc_id: r for r in licences.licence_report(d).collect()}
    assert len(rows) == 6 and rows[3].n_notices == 0 and rows[5].licences == "CC-BY-NC-4.0,MIT"
    f = licences.scan_licences(d).where("doc_id = 1").first()
    assert texts[1][f.start : f.end].startswith("licensed under") and f.differences == ["license -> licence"]


def test_licence_templates_propose_blocks(spark):
    filler = " ".join(w for i, w in corpus() if w)[:900]
    notices = {"All-rights-reserved": "All rights reserved", "SPDX": "SPDX-License-Identifier: GPL-2.0-only OR MIT", "Copyright": "Copyright \u00a9 2019-2021", "MIT": "Released under the MIT License"}
    texts = {name: f"{filler}\n{notice}{tail}\n{filler}" for name, notice in notices.items() for tail in [" Jane" if name == "Copyright" else ""]}
    d = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {(r.doc_id, r.licence, texts[r.licence][r.start : r.end]) for r in licences.scan_licences(d).collect()}
    assert got == {(i, name, notice) for i, (name, notice) in enumerate(notices.items())}
    own = {"DE": "Alle Rechte vorbehalten."}
    mine = spark.createDataFrame([(0, f"{filler}\nAlle Rechte vorbehalten.\n{filler}")], "doc_id long, text string")
    assert [r.licence for r in licences.scan_licences(mine, own).collect()] == ["DE"]
    late = licences.TEMPLATES["MIT-text"].replace("Permission", "Authorisation").replace("restriction", "limits").replace("documentation", "papers")
    assert [x[2] for x in licences.Scanner().scan(f"{filler}\n{late}\n{filler}")] == ["MIT-text"]


def test_licence_alignment_is_local():
    altered = "This text is licensed under the GNU General Public License, version 3."
    scan = licences.Scanner().scan
    for before in ("", "this ", "Is this the work? ", "This is what the version of 3 is under. " * 3):
        text = f"{before}and so on:\n{altered}\nNo work of this kind."
        found = scan(text)
        assert [(text[s:e], name, d) for s, e, name, _, d in found] == [(altered[:-1], "GPL-3.0", ["work -> text"])]
    copies = [altered, altered.replace("text", "work").replace("under", "by"), altered.replace("text is", "work was"), altered.replace("text", "work").replace(", version", " release")]
    text = "\nthis is\n".join(copies)
    assert [text[s:e] for s, e, _, _, _ in scan(text)] == [c[:-1] for c in copies]
    assert not scan(altered.replace("GNU General", "Big Private"))


def test_licence_report_is_by_row(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    d = spark.createDataFrame([(None, mit), (None, None), (1, cc), (1, "none"), (1, f"{cc}\n{mit}\n{mit}")], "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_notices, r.licences, r.spans) for r in licences.licence_report(d).collect())
    assert got == [("1", 0, "", ""), ("1", 1, "CC-BY-NC-4.0", "CC-BY-NC-4.0:0:27:0"), ("1", 3, "CC-BY-NC-4.0,MIT", "CC-BY-NC-4.0:0:27:0,MIT:29:59:0,MIT:61:91:0"), ("None", 0, "", ""), ("None", 1, "MIT", "MIT:0:30:0")]


def test_anchor_is_of_the_words():
    w = [str(k % 37) for k in range(120)]
    (a,), (b,) = (substrings.anchors(pa.array([" ".join(x)]), 50) for x in (w, ["zz", *w]))
    assert len(a) == 71 and (a == b[1:]).all() and Counter(a.tolist()).most_common(1)[0][1] <= 71
    x = np.random.default_rng(2).integers(0, 9, 100)
    assert all((substrings.sliding_min(x, n) == [x[k : k + n].min() for k in range(101 - n)]).all() for n in (1, 2, 3, 7, 43, 64, 100))


def test_hashed_words():
    """Hashes are those of the words' bytes, wherever they stand and however long they are."""
    r = random.Random(7)
    texts = [None, "", "x" * 300_000 + " y " + "x" * 300_000, "a b" * 60_000] + ["".join(r.choice(["a", "B", "\u00e9", " ", "\t", "zz", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(200)]
    for column in (pa.array(texts), pa.array(["before", *texts]).slice(1)):
        for lower in (False, True):
            words = [common.ascii_words(t, lower) for t in texts]
            hashes, starts, ends, first = common.hashed_words(common.texts_of(column), lower)
            assert np.diff(first).tolist() == [len(w) for w in words]
            seen = {}
            assert all(seen.setdefault(w, h) == h for w, h in zip([w for ws in words for w in ws], hashes.tolist())) and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("bands, rows", [(32, 4), (5, 3), (7, 2)])
def test_bands_are_independent(bands, rows):
    """No value serves two bands, no band takes one permutation twice; pairs are missed as rarely as that predicts."""
    from codeseam.llm import near_dedup as nd

    columns, half = nd.band_columns(bands, rows), (bands * rows + 1) // 2
    assert len(np.unique(columns)) == bands * rows
    assert all(len(set(c % half)) == rows for c in columns)
    rng, missed, pairs, s = np.random.default_rng(5), 0, 3000, 0.6
    mul, add = nd.permutations(half)
    for _ in range(pairs // 500):
        base = [rng.integers(0, 2**63, 80, dtype=np.uint64) for _ in range(500)]  # 48 of 80 in both
        a, b = ([x[:64] for x in base], [np.r_[x[:48], x[64:]] for x in base])
        ka, kb = (nd.band_keys(nd.min_max(x, mul, add), bands, rows) for x in (a, b))
        missed += int((ka != kb).all(axis=1).sum())
    expected = pairs * (1 - s**rows) ** bands
    assert abs(missed - expected) < 5 * np.sqrt(expected + 1), (missed, expected)
