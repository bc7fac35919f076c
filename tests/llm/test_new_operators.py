"""The prefix trie, the alignment of tokenizers and the quality rules against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeseam.llm import alignment, outliers, prefix_trie
from codeseam.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- prefix trie


def trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    conv = {c: [v[3:] for v in sorted(x)] for c, x in conv.items()}
    full = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = (*conv.get(c - c % 5, [])[:h], *own[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(full[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    r = random.Random(3)
    rows = [(None, 0, "user", "no conversation"), (0, None, None, None), (0, None, "user", "é"), (0, 1, "user", ""), (0, 1, "user", ""), (1, 0, "user", "alone")]
    for c in range(5, 160):
        first = r.choice(["hello", "hello", "é" * r.randint(1, 3), None])
        for k in range(r.randint(1, 14)):
            rows.append((c * 3, k, ("user", "assistant")[k % 2], first if k == 0 else r.choice("ab")))
    long = [(1000 + 5 * c, k, "user", f"turn {k}") for c in range(6) for k in range(60 + (c > 3) * 7)]  # copies, and one that goes on
    return rows + long + [(2001, k, "user", "turn 0" if k else "x") for k in range(30)]


@pytest.mark.parametrize("small", [50_000, 200, 0])
def test_trie(spark, small):
    rows = conversations()
    turns = spark.createDataFrame([(*x, "clash", 7) for x in rows], "conv_id long, turn long, role string, text string, id string, depth int").repartition(3)
    got = prefix_trie.digest_trie(prefix_trie.conversation_trie(turns, small_class=small)).collect()
    want = trie(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert any(n[3] > 1 and n[4] == 0 for n in want) and any(n[1] > 50 for n in want)


def test_trie_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(turns).count() == 0
    alone = spark.createDataFrame([(None, 1, "user", "x")], turns.schema)
    assert prefix_trie.conversation_trie(alone).count() == 0


def test_hash_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    ids = spark.range(-5, 3000).select(F.lit(b"k").alias("key"), "id").union(spark.createDataFrame([(b"other", 3)], "key binary, id long")).repartition(5)
    got = {bytes(r.key): r.ends for r in prefix_trie._hash_of_ids(ids).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, range(-5, 3000))).encode()).hexdigest(), b"other": hashlib.sha256(b"3").hexdigest()}


# ---------------------------------------------------------------- alignment

PATHS = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    "a  b", " lead", "trail ", "x\n y", "x \ny", "a\n\nb c", "▁a b", "a ▁ b", "<|endoftext|> a", "it's we'll", "日本語 テスト", "😀 x", "é́ ﬁ", "\x00a b", "a\xa0b c", "  z", "don’t 12345 67",
    "a\r\nb", None, "", "a", "x y " * 300, "a" * 3000, " " * 50, "<s> </s> <unk> <0x0A>", "İstanbul ſ", "a\tb c\td", "q\x85 r", "word word word", "\n", " ",
]


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(PATHS[0]))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PATHS[1]))
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    byte = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(plain)))}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    return lambda t: [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in b.encode(t)]


def aligned(rows):
    left, right = encoders()
    docs = []
    for d, t in rows:
        a, b = (left(t), right(t)) if t else ([], [])
        if not (a and b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode()):
            docs.append((d, [], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b)]
        links = [(i, j) for (i, x), e in zip(a, ends[0]) for (j, y), f in zip(b, ends[1]) if e - len(x) < f and f - len(y) < e]
        groups, at = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(s, en) if at < e <= cut) for s, en in zip((a, b), ends)))
            at = cut
        docs.append((d, a, b, links, ";".join(groups)))
    n = Counter(p for x in docs for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), k in n.items():
        best[a] = max(best[a], k)
    return sorted(
        ((d, len(a), len(b), g.count("|"), len(x), sum(n[p] == best[p[0]] for p in x), sum(n[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, x, g in docs), key=str
    )


def texts():
    r = random.Random(11)
    words = "the of anthropology, Überprüfung naïve 2024-05-06 x == y; don't\nstop — «été» antidisestablishmentarianism".split(" ")
    return [*ODD, *(" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)), ODD[9], ODD[9]]


@pytest.mark.parametrize("held", [4_000_000, 20])
def test_alignment(spark, held):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, pairs string, row int").repartition(3)
    a, b = map(tokenizer_path, PATHS)
    got = alignment.cross_tokenizer_alignment(docs, a, b, held_pairs=held).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == aligned(rows)
    assert alignment.cross_tokenizer_alignment(docs.limit(0), a, b).count() == 0


def test_ids_are_the_library_s():
    ours, (left, right) = alignment.held_aligner(*map(tokenizer_path, PATHS)), encoders()
    assert ours.a.ranked and ours.by_words
    for t in texts():
        if t:
            assert ours.a.encode([t])[0] == [i for i, _ in left(t)]
            assert t.startswith(" ") or "▁" in t or ours.b.encode([t])[0] == [i for i, _ in right(t)]


def test_words_are_the_whole_text():
    """Aligning word by word gives what aligning the whole text gives."""
    ours = alignment.held_aligner(*map(tokenizer_path, PATHS))
    for t in texts():
        if t:
            assert ours.texts([t])[0] == ours.text(t, None)


def test_group_products():
    a, b = np.array([5, 6, 7]), np.array([8, 9])
    x = alignment.align(a, b, np.array([1, 3, 6]), np.array([2, 6]))
    assert list(zip(x.owner_a, x.owner_b)) == [(0, 0), (1, 0), (1, 1), (2, 1)]
    assert list(zip(*alignment.group_products(x))) == [(i, j) for i in range(3) for j in range(2)]
    y = alignment.align(a, b, np.array([1, 3, 6]), np.array([3, 6]))
    assert list(zip(*alignment.group_products(y))) == [(0, 0), (1, 0), (2, 1)]


# ---------------------------------------------------------------- quality rules


def counts(text):
    w = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    often, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(inside)


def quality_corpus():
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = [None, "", " \t\n", "one", "a b c a b c", "x\x0by\x0cz\r\nq\tq", "\n\nsame\n same\nsame\n\n", "from " * 500, "#" * 5000, "a b " * 40 + " ".join(vocab), "é" * 30000]
    for _ in range(330):
        w = [r.choice(vocab) for _ in range(r.randint(50, 400))]
        rows.append("".join(x + r.choice(["\n", " ", " ", " ", "  "]) for x in w))
    for k in range(8):  # symbols all over, or words as long as lines
        w = [r.choice(vocab) for _ in range(200)]
        rows.append(" ".join(x + "$$%" for x in w) if k % 2 else " ".join(x * 40 for x in w))
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3] if i < 250 else "xx" if i == 300 else "fr", f"s{i % 2}") for i, t in enumerate(rows)]


def test_counts(spark):
    rows = quality_corpus()
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, lang string, source string, n_words int").repartition(3)
    got = {r.doc_id: tuple(r)[3:] for r in outliers.document_statistics(docs).collect()}
    assert got == {i: counts(t) for i, t, _, _ in rows}


def test_windows_of_one_hash(spark):
    """Where different windows share a hash, their words decide."""
    words = "a b c d a b c e a b d".split()
    df = spark.createDataFrame([(words, [3] * 9)], "w array<string>, h array<long>")
    assert df.select(outliers._repeated(F.col("h"), F.col("w"))).first()[0] == counts(" ".join(words))[4] == 6


def rejected(rows, share, least):
    """The same estimates by hand: three starts, two steps each, the best one to its end; whole classes of distances."""
    stats = {i: (counts(t), lang, source) for i, t, lang, source in rows}
    ok = {i: v for i, v in stats.items() if v[0][0] >= 50 and 100 * v[0][4] <= 50 * v[0][0]}
    sizes = Counter((x[1], x[2]) for x in ok.values())
    first = Counter()
    for k, n in sizes.items():
        first[k[0]] += n * (n < least)
    rest = sum(n for n in first.values() if n < least)

    def key(x):
        return (x[1], x[2]) if sizes[x[1], x[2]] >= least else (x[1],) if first[x[1]] >= least else () if rest >= least else None

    groups = defaultdict(list)
    for i, x in ok.items():
        groups[key(x)].append(i)
    floors = np.array(list(outliers.FLOORS.values())) * 1000
    out = {i: None for i in stats}
    for k, ids in groups.items():
        if k is None:
            continue
        c = np.array([ok[i][0] for i in ids], float)
        x = np.round(1000 * np.column_stack([np.log(c[:, 0]), np.log(c[:, 1] / c[:, 0]), np.log1p(1000 * c[:, 2] / c[:, 1]), np.log1p(c[:, 3]), np.log1p(100 * c[:, 4] / c[:, 0])]))
        n = len(x)

        def distance(m, cov):
            return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)

        def step(m, cov):
            cl = np.minimum(np.floor(outliers.CLASSES * np.log1p(distance(m, cov))), outliers.LAST_CLASS)
            last = min(v for v in cl if (cl <= v).sum() >= share * n)
            near = x[cl <= last]
            return near.mean(0), np.cov(near.T, bias=True) + np.diag(floors**2)

        v = np.sort(np.floor(x / 10), axis=0)
        q = [v[-(-j * n // 4) - 1] for j in (1, 2, 3)]
        m, d = q[1] * 10 + 5, np.sqrt(((q[2] - q[0]) * 10 / 1.349) ** 2 + floors**2)
        z = (x - m) / d
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        sign = np.round(1000 * np.divide(z, norm, out=np.zeros_like(z), where=norm > 0))
        clip = np.round(1000 * np.clip(z, -2, 2))
        scale = np.diag(d)
        starts = [np.diag(d**2), scale @ (sign.T @ sign) @ scale * 5 / (sign**2).sum() + np.diag(floors**2), scale @ (clip.T @ clip) @ scale / n / 1e6 + np.diag(floors**2)]
        best = []
        for s in starts:
            e = (m, s)
            for _ in range(outliers.FIRST_STEPS):
                e = step(*e)
            best.append((np.linalg.slogdet(e[1])[1], len(best), e))
        e = min(best, key=lambda b: b[:2])[2]
        for _ in range(outliers.MOST_STEPS):
            e, was = step(*e), e
            if abs(np.linalg.slogdet(e[1])[1] - np.linalg.slogdet(was[1])[1]) < outliers.EPSILON / 1e6:
                break
        for i, d2 in zip(ids, distance(*e)):
            out[i] = d2
    return out


@pytest.mark.parametrize("least", [30])
def test_outliers(spark, least):
    rows = quality_corpus()
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, source string, distance string").repartition(3)
    want = rejected(rows, outliers.SHARE, least)
    scored = outliers.outlier_scores(docs, least_rows=least)
    got = {r.doc_id: r.distance for r in scored.collect()}
    assert got.keys() == want.keys() and all((got[i] is None) == (want[i] is None) for i in want)
    assert all(abs(got[i] - want[i]) < 0.02 * (1 + want[i]) for i in want if want[i] is not None)
    kept = {r.doc_id: r.kept for r in outliers.digest_outliers(scored).collect()}
    bad = {i for i, *_ in rows[-8:]}
    assert not any(kept[i] for i in bad) and not any(kept[i] for i in range(5))
    assert sum(kept.values()) >= 320
    good = outliers.keep_inliers(docs, least_rows=least)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, k in kept.items() if k}


def test_outliers_without_groups(spark):
    docs = spark.createDataFrame([(1, "word " * 3), (None, " ".join(f"w{i}" for i in range(80))), (1, None)], "doc_id long, text string")
    got = outliers.digest_outliers(outliers.outlier_scores(docs)).collect()
    assert sorted((r.n_words, r.base_failed, r.kept, r.distance) for r in got) == [(0, True, False, None), (3, True, False, None), (80, False, True, None)]
    assert outliers.outlier_scores(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- licences: compression decides


def test_ranking_decides(monkeypatch):
    """Of two wordings that the exact words would both allow, the one that compresses the block best is reported."""
    from codeseam.llm import licences

    wording = "this programme is given away freely under the terms of the garden licence of the village council and nothing else at all"
    own = {"a-near": wording.replace("garden", "meadow").replace("village", "county"), "b-exact": wording}
    text = "some words before it " + wording + " and some behind"
    scanner = licences.Scanner(own)
    assert [(x[2], len(x[4])) for x in scanner.scan(text)] == [("b-exact", 0)]
    true = scanner.savings
    monkeypatch.setattr(scanner, "savings", lambda block, names: [s + (name == "a-near") for s, name in zip(true(block, names), names)])
    assert [(x[2], len(x[4])) for x in scanner.scan(text)] == [("a-near", 2)]


def test_each_template_compresses_each_block(monkeypatch):
    from codeseam.llm import licences

    scanner, asked = licences.Scanner(), []
    true = scanner.savings
    monkeypatch.setattr(scanner, "savings", lambda block, names: asked.append(list(names)) or true(block, names))
    assert [x[2] for x in scanner.scan("see the words. Released under the MIT License. Bye")] == ["MIT"]
    assert asked[0] == list(licences.TEMPLATES)


def test_many_differences():
    """A long text may differ by its share of words, whatever their number."""
    from codeseam.llm import licences

    r = random.Random(4)
    words = licences.TEMPLATES["MIT-text"].replace("<year>", "2024").split()
    for k in r.sample(range(len(words)), 12):
        words[k] = "other"
    found = licences.Scanner().scan(" ".join(words))
    assert [x[2] for x in found] == ["MIT-text"] and sum(len(d.split(" -> ")[1].split()) for d in found[0][4]) >= 10


# ---------------------------------------------------------------- chat: foreign columns named parts


@pytest.mark.parametrize("foreign", ["'x'", "7", "array('a')", "struct(1 AS type)", "array(struct(1 AS a))", "map('type', 'text')"])
def test_foreign_parts(spark, foreign):
    from codeseam.llm import chat

    turns = spark.createDataFrame([(1, 0, "user", "hello <|end|>")], "conv_id long, turn long, role string, text string")
    want = chat.digest_chat(chat.format_chat(turns)).collect()
    assert chat.digest_chat(chat.format_chat(turns.withColumn("parts", F.expr(foreign)))).collect() == want
