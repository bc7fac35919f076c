"""The pipeline's stages on the smallest driver tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages(spark):
    import corpus_pipeline as p

    from codeseam.llm.decontaminate import contamination
    from codeseam.llm.exact_dedup import exact_duplicates
    from codeseam.llm.near_dedup import near_duplicates

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, kept, SF))
        assert after.columns == docs.columns and 0 < after.count() <= kept.count(), name
        assert after.join(kept, docs.columns, "left_anti").count() == 0
        kept = after
    assert exact_duplicates(kept).where("not kept").count() == 0
    assert near_duplicates(kept).where("not kept").count() == 0
    assert contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(spans) > 0").count() == 0
    packed = p.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_stages(rows, good, items):
    """Naive versions of the stages after scoring: the rows (doc_id, text) that each leaves."""
    import re

    out = [[r for r in rows if good[r]]]
    first = {}
    for i, t in out[-1]:
        key = (t or "").translate(LOW)
        first[key] = max(first.get(key, (i, t)), (i, t), key=lambda x: -1 if x[0] is None else x[0])
    out.append(list(first.values()))
    sets = []
    for i, t in out[-1]:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(out[-1]):
        least[find(k)] = min(least.get(find(k), i), i)
    out.append([r for k, r in enumerate(out[-1]) if r[0] == least[find(k)]])
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    runs = set()
    for t in items:
        w = words(t)
        n = min(10, len(w))
        runs |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(r) for r in runs}
    out.append([(i, t) for i, t in out[-1] if not any(tuple(w[k : k + n]) in runs for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))])
    return out


def test_against_brute_force(spark, tmp_path):
    """The whole pipeline on a small corpus with copies, near copies, leaks, nulls, shared ids and clashing columns."""
    import random

    import numpy as np
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from codeseam.llm import quality
    from codeseam.llm.queries import tokenizer_path

    r = random.Random(8)
    vocab = ["the", "house", "is", "green", "and", "river", "flows", "down", "under", "old", "bridge", "near", "town", "where", "birds", "sing"]
    good = lambda n: " ".join(r.choice(vocab) + str(r.randrange(40)) for _ in range(n))
    leak = good(30)
    texts = [good(r.randint(40, 120)) + "." for _ in range(60)] + [" ".join(r.choice(["%%%", "$$x", "|", "a###"]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(200, texts[3].upper()), (201, texts[3]), (202, texts[5] + " more"), (203, texts[7] + " x y"), (5, good(50)), (7, good(60)), (7, texts[9]), (204, good(20) + " " + leak + " " + good(20)), (205, texts[11]), (205, texts[11])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "c") for i, t in rows], "doc_id long, text string, lang string, source string, count long, hash string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string")
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    model = quality.fit(docs, quality.not_held_out(labels))
    scores = {x: quality.predict(np.array([quality.statistics(x[1])], float), model)[0] >= 0.5 for x in rows}
    assert all(scores[x] == (x[0] < 60 or x[0] >= 200 or (len(x[1]) > 300 and "%%%" not in x[1])) or "%%%" not in x[1] for x in rows)
    want, now = brute_stages(rows, scores, [leak]), docs
    for (name, stage), rest in zip(p.STAGES[:-1], want):
        now = p.stored(stage(spark, now, sf))
        assert now.columns == docs.columns
        assert sorted((x.doc_id, x.text) for x in now.collect()) == sorted(rest), name
    assert len(want[0]) > len(want[1]) > len(want[2]) > len(want[3])
    tok, ids = Tokenizer.from_file(tokenizer_path()), {}
    for i, t in want[-1]:
        ids.setdefault(i, []).append(len(tok.encode(t, add_special_tokens=False).ids) + 1)
    got: dict = {}
    for x in p.run(spark, sf).collect():
        got.setdefault(x.doc_id, []).append(x.length)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in ids.items()}


def test_repeated_ids_in_copies(spark):
    """A dropped copy doesn't come back where its id has another text too; of repeated rows one stays."""
    import corpus_pipeline as p

    rows = [(9, "same", 1), (2, "same", 1), (2, "other", 1), (2, "other", 1), (None, "n", 1), (None, "n", 1), (9, "SAME", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, count int")
    left = sorted((repr(x.doc_id), x.text.lower()) for x in p.exact_copies(spark, d, "").collect())
    assert left == [("2", "other"), ("9", "same"), ("None", "n")]
    assert sorted((repr(x.doc_id), x.text.lower()) for x in p.near_copies(spark, d, "").collect()) == [("2", "other"), ("2", "same"), ("None", "n")]
