"""Operators that SQL can't express against naive versions, and their edges: nulls, empty, long, tied, repeated, clashing."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from codeseam.llm import chat, common, language, licences, packing, pii, quality
from codeseam.llm.queries import tokenizer_path

EDGES = [(1, None), (1, ""), (2, "one two"), (2, "one two"), (None, "x"), (3, "word " * 60_000), (4, "é😀 ß"), (5, " \t\n")]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeats, shared ids, columns whose names operators use."""
    names = "lang score kept spans items pii stats label fold piece start length count row hash"
    rows = [(i, t, *["c"] * len(names.split())) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names.split())).repartition(2)


# language


def naive_model(rows):
    """P(c | a, b) of each language, interpolated from counts of words' symbols."""
    def symbols(text):
        return [language._SYMBOL[b] for b in language.normalised(text)]

    counts = defaultdict(Counter)
    for lang, text in rows:
        s = symbols(text)
        counts[lang].update((s[k], s[k + 1], s[k + 2]) for k in range(len(s) - 2) if s[k + 1])
    three, two, one, none = language.WEIGHTS

    def log_p(lang, a, b, c):
        g = counts[lang]
        pair = sum(n for t, n in g.items() if t[:2] == (a, b))
        mid = sum(n for t, n in g.items() if t[1] == b)
        low = two * (sum(n for t, n in g.items() if t[1:] == (b, c)) / mid if mid else 0) + one * sum(n for t, n in g.items() if t[2] == c) / sum(g.values()) + none / 64
        low /= 1 if mid else 1 - two
        return math.log(three * g[a, b, c] / pair + low if pair else low / (1 - three))

    def word_scores(text):
        out = []
        for w in language.normalised(text).split():
            s = [0, *(language._SYMBOL[b] for b in w), 0]
            out.append([sum(log_p(x, *s[k : k + 3]) for k in range(len(s) - 2)) for x in sorted(counts)])
        return np.array(out)

    return sorted(counts), word_scores


def naive_mixture(scores):
    like = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -40))

    def em(cols):
        pi = [1 / len(cols)] * len(cols)
        for _ in range(language.EM_STEPS):
            shares = np.zeros(len(cols))
            for row in like[:, cols]:
                joint = row * pi
                shares += joint / joint.sum()
            new = shares / len(like)
            done = np.abs(new - pi).max() < 1e-4
            pi = new
            if done:
                break
        return pi, sum(math.log((row * pi).sum()) for row in like[:, cols])

    chosen = [int(np.log(like).sum(axis=0).argmax())]
    pi, best = em(chosen)
    while len(chosen) < like.shape[1]:
        mixed = like[:, chosen] @ pi
        gains = [-math.inf if k in chosen else np.log(0.5 * like[:, k] + 0.5 * mixed).sum() for k in range(like.shape[1])]
        wider = [*chosen, int(np.argmax(gains))]
        p, value = em(wider)
        if value - best <= math.log(len(like) + 1):
            break
        chosen, pi, best = wider, p, value
    return dict(zip(chosen, pi))


def test_language_is_naive_em(spark):
    r = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi", "é"], "bb": ["thr", "ing", "ou"], "cc": ["zu", "xi", "ñ"]}
    make = lambda x, n: " ".join("".join(r.choice(parts[x]) for _ in range(2)) for _ in range(n))
    train = [(x, make(x, 12)) for x in parts for _ in range(3)]
    texts = [make("aa", 8), make("bb", 5) + " " + make("cc", 6), make("aa", 6) + " " + make("bb", 6) + " " + make("cc", 6), "kathr", "Q"]
    names, score = naive_model(train)
    model = language.train(spark.createDataFrame(train, "lang string, text string"))
    assert model[0] == names
    got = {x.doc_id: {m.lang: m.share for m in x.mixture} for x in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        want = {names[i]: p for i, p in naive_mixture(score(t)).items()}
        assert got[k].keys() == want.keys() and all(abs(got[k][x] - p) < 1e-3 for x, p in want.items()), t


def test_language_edges(spark, edges):
    model = language.train(spark.createDataFrame([("en", "one two word"), ("xx", "zzz qqq"), (None, "a"), ("yy", None), ("zz", "..")], "lang string, text string"))
    got = sorted((repr(r.doc_id), r.lang_pred) for r in language.identify(edges, model).collect())
    assert [x for x in got if x[0] in ("1", "2", "3")] == [("1", "und")] * 2 + [("2", "en")] * 2 + [("3", "en")] and len(got) == len(EDGES)
    assert language.identify(edges.limit(0), model).count() == 0


# licences


def naive_licences(text, most):
    """Names of templates with a stretch of the text within their number of changes, by full alignment."""
    got = [licences.word(m[0]) for m in licences._WORD.finditer(text)]
    out = set()
    for name, wording in licences.TEMPLATES.items():
        want = licences.wanted_words(wording)
        row = [0] * (len(got) + 1)
        for j, w in enumerate(want, 1):
            new = [j]
            for i, g in enumerate(got, 1):
                new.append(min(row[i - 1] + (g != w), row[i] + 1, new[i - 1] + 1))
            row = new
        if min(row) <= most(len(want)):
            out.add(name)
    return out


def test_licences_are_naive_alignments(spark):
    r = random.Random(9)
    filler = lambda n: " ".join(r.choice(["a", "river", "of", "text", "license", "use", "any"]) for _ in range(n))
    texts = []
    for name in ("MIT-text", "GPL-3.0", "BSD", "Zlib", "CC-BY-4.0", "Apache-2.0-header", "ISC-grant", "Copyright"):
        words = licences.TEMPLATES[name].replace("<year>", "2024").split()
        for changes in (0, 1, 4, 14):
            w = list(words)
            for k in r.sample(range(len(w)), min(changes, len(w))):
                w[k] = r.choice(["zip", "zap"])
            texts.append(f"{filler(30)}\n{' '.join(w)}\n{filler(30)}")
    texts += [filler(80), None, ""]
    found = defaultdict(set)
    for x in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found[x.doc_id].add(x.licence)
    for k, t in enumerate(texts):
        naive = naive_licences(t or "", lambda n: licences.allowed(n, licences.MAX_DIFFERENCES))
        assert found[k] <= naive and bool(found[k]) == bool(naive), (t, found[k], naive)


def test_licence_edges(spark, edges):
    got = licences.licence_report(edges).collect()
    assert len(got) == len(EDGES) and all(r.n_notices == 0 for r in got) and licences.licence_report(edges.limit(0)).count() == 0
    notice = "Released under the MIT License."
    many = spark.createDataFrame([(1, f"{notice} " * 4000), (2, "license software copyright " * 8000)], "doc_id long, text string")
    assert {r.doc_id: r.n_notices for r in licences.licence_report(many).collect()} == {1: 4000, 2: 0}
    pieces = list(licences.pieces(0, 50_000, 100))
    assert pieces[0][0] == 0 and pieces[-1][1] == 50_000 and all(a[1] - b[0] == 100 for a, b in zip(pieces, pieces[1:]))


# quality


def test_quality_is_ridge_in_closed_form(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "house", "is", "green", "and"] if k < 60 else ["%%%", "$$x", "|", "the"]) for _ in range(r.randint(5, 60))) for k in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, label int")
    model = quality.fit(d, labels)
    x = np.array([quality.statistics(t) for t in texts], np.float32).astype(float)
    y = np.array([float(k < 60) for k in range(120)])
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    phi = quality.expand(x, mean, sd)
    weights = np.linalg.solve(phi.T @ phi + quality.RIDGE * len(y) * np.eye(phi.shape[1]), phi.T @ y)
    assert np.allclose(model["mean"], mean) and np.allclose(model["sd"], sd) and np.allclose(phi @ model["weights"], phi @ weights, atol=1e-6)
    assert (np.diff(model["curve"]) >= 0).all()
    got = {s.doc_id: s.score for s in quality.quality_scores(d, labels).collect()}
    raw = phi @ weights
    order = np.argsort(raw)
    assert (np.diff(np.array([got[k] for k in order.tolist()])) >= -1e-9).all()


def test_isotonic_is_the_nearest_rising_curve():
    r = np.random.default_rng(3)
    total, ones = np.full(12, 50.0), r.integers(0, 51, 12).astype(float)
    got, mean = quality.isotonic(total, ones), ones / total
    naive = [max(min(mean[a : b + 1].mean() for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
    assert np.abs(got - naive).max() < 0.02  # the operator shrinks blocks a little towards the share of ones


def test_quality_thins_labels(spark, monkeypatch):
    d = spark.createDataFrame([(k, "a b" if k % 2 else "% $") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, label int")
    monkeypatch.setattr(quality, "MAX_TRAINING_ROWS", 100)
    assert 40 < quality.training_rows(d, labels).count() <= 100
    got = {r.doc_id: r.score for r in quality.quality_scores(d, labels).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(400))


def test_quality_edges(spark, edges):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (2, None), (99, 0)], "doc_id long, label int")
    got = quality.quality_scores(edges, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(edges, labels, 0.0)
    assert kept.count() == len(EDGES) and kept.columns == edges.columns


# personal data


def test_pii_scores(spark, edges):
    rows = [(1, "4111 1111 1111 1111"), (2, "my card 4111 1111 1111 1111"), (3, "x 10.0.0.1 y"), (4, "the server 10.0.0.1"), (5, "a@b.cd a@b.cd " * 700)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.pii for r in pii.find_pii(d).collect()}
    assert [round(got[k][0].score, 6) for k in (1, 2, 3, 4)] == [0.9, 1.0, 0.5, 0.7]
    assert [(s.start, s.end) for s in got[5]] == [(7 * k, 7 * k + 6) for k in range(1400)]
    assert pii.redact(pii.find_pii(d.where("doc_id = 3")), 0.6).first().text == "x 10.0.0.1 y"
    found = pii.digest_pii(pii.find_pii(edges))
    assert found.count() == len(EDGES) and found.where("spans <> ''").count() == 0


# chat


def test_chat_parts(spark):
    part = lambda kind=None, text=None, **k: (kind, text, *(k.get(x) for x in ("ref", "width", "height", "seconds", "pages")))
    turns = [
        (1, 0, "user", "unused", [part("text", "a<"), part("text", "|turn|>b"), part("image", ref="i", width=28, height=15), part("audio", ref="s", seconds=2.0), None]),
        (1, 1, "assistant", "unused", [part("text", "see "), part("document", ref="d", pages=3), part("text", "!"), part("video", ref="v")]),
        (1, 2, "user", "t", [part("audio", seconds=float("nan")), part("audio", seconds=-1.0), part("image", width=-5), part("document", pages=0), part(None, "plain")]),
        (1, 3, "user", "only", None), (1, 4, "user", "only", []),
    ]
    d = spark.createDataFrame([(*t, "c") for t in turns], f"conv_id long, turn long, role string, text string, parts {chat.PART_TYPE}, seq string")
    s = chat.format_chat(d).orderBy("seq").collect()
    assert [[a.tokens for a in x.attachments] for x in s] == [[4, 50], [1536, 0], [0, 0, 1, 512], [], []]
    assert [a.n for x in s for a in x.attachments] == list(range(8)) and [a.kind for a in s[1].attachments] == ["document", "other"]
    assert [chat.read_turn(x.segment)[1] for x in s] == ["a<|turn|>b", "see !", "plain", "only", ""]
    assert s[1].segment[s[1].mask_from : s[1].mask_to] == "see <|document:2|>!<|other:3|>"
    r = chat.digest_chat(chat.format_chat(d)).first()
    assert (r.n_turns, r.loss_chars, r.attachments, r.attachment_tokens) == (5, 5, 8, 2103)


# packing


def test_packing_edges(edges):
    got = packing.best_fit_packing(edges, tokenizer_path()).collect()
    assert len({(r.doc_id, r.start) for r in got if r.doc_id == 3}) == -(-60_001 // 4096) and sum(r.length for r in got if r.doc_id == 2) == 6
    assert packing.best_fit_packing(edges.limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit_packing(edges, tokenizer_path(), max_cost=4096)


def test_plain_words_are_the_librarys():
    words = packing.held_words(tokenizer_path())
    assert words.model is not None
    plain = [chr(c) for c in range(0x2100) if packing._PLAIN.fullmatch(chr(c))]
    r = random.Random(1)
    texts = ["".join(r.choice(plain) if r.random() < 0.5 else r.choice("ab 's'll1,_É<|endoftext|>") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|STARTOFTEXT|>", "漢字 and ﬁ", "", "x" * 5000]
    assert words.encode(texts) == [words.whole(t) for t in texts]
    other = packing.load_tokenizer(tokenizer_path())
    from tokenizers import normalizers

    other.normalizer = normalizers.Lowercase()
    assert packing.WordIds(other).model is None


def naive_score(rule, weights, n, tokens, docs, cost, capacity, max_docs, max_cost):
    w = [x / y**2 for x, y in zip(weights, (capacity, max_docs, max_cost))]
    if rule == "norm":
        return -w[0] * (tokens - n) ** 2 - w[1] * (docs - 1) ** 2 - w[2] * (cost - n * n) ** 2
    return w[0] * n * tokens + w[1] * docs + w[2] * n * n * cost


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 100 * 100), (4, 6000)])
def test_every_choice_is_best(rule, limits):
    """Played over again: each item goes to a bin with the best score of all that can take it, a new one only if none can."""
    capacity, (max_docs, max_cost) = 100, limits
    n = np.random.default_rng(5).integers(1, 70, 500)
    bins, offset = packing.vector_best_fit(n, capacity, max_docs, max_cost, rule)
    left: dict[int, tuple] = {}
    for item in np.argsort(-n, kind="stable"):
        size = int(n[item])
        fits = {b: s for b, s in left.items() if s[0] >= size and s[1] >= 1 and s[2] >= size * size}
        score = {b: naive_score(rule, (1.0, 1e-3, 1e-3), size, *s, capacity, max_docs, max_cost) for b, s in fits.items()}
        b = int(bins[item])
        assert (b in fits and abs(score[b] - max(score.values())) < 1e-12) if fits else b not in left
        s = left.get(b, (capacity, max_docs, max_cost))
        assert offset[item] == capacity - s[0]
        left[b] = (s[0] - size, s[1] - 1, s[2] - size * size)
    if limits[0] == 100 and rule == "norm":  # slack limits: as many bins as plain best fit by decreasing length
        rest: list[int] = []
        for size in sorted(n.tolist(), reverse=True):
            fit = min((r for r in rest if r >= size), default=None)
            if fit is None:
                rest.append(capacity - size)
            else:
                rest[rest.index(fit)] -= size
        assert len(left) == len(rest)


# shared


def test_a_cluster_must_name_its_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: folder, set=lambda *a: None), sparkContext=SimpleNamespace(master=master))

    assert common.shared_dir(session("spark://h:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[4]", None)).startswith("file://")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master, None))
