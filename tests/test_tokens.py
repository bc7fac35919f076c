import pytest
from pyspark.sql import functions as F

from codeseam.operators import batching
from codeseam.plans import catalog

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_are_the_tokenizers(spark, monkeypatch):
    monkeypatch.setattr(batching, "TOKENIZED_CHARACTERS", 40)
    texts = ["def f(x):\n    return x", "", None, "a" * 100_000, "Grüße, 世界 <|endoftext|>", "\x00\r\n", "again", "again"]
    got = batching.with_tokens(spark.createDataFrame(list(enumerate(texts)), "k long, content string"), PATH)
    want = {k: None if t is None else len(model().encode(t, add_special_tokens=False)) for k, t in enumerate(texts)}
    assert {r.k: r.tokens for r in got.collect()} == want and want[1] == 0
    assert batching.with_tokens(got.select("content").limit(0), PATH).count() == 0


def test_batches_by_tokens(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(catalog.QUERIES["n11_tokenizer_batches"](spark, sf).collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    m, batch, total = model(), 0, 0
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        assert r.tokens == len(m.encode(texts[r.doc_id], add_special_tokens=False))
        if total and total + r.tokens > 8000:
            batch, total = batch + 1, 0
        total += r.tokens
        assert first.setdefault(batch, r.batch_id) == r.batch_id
    assert len(rows) == len(texts) and len(set(first.values())) == batch + 1
