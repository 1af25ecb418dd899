import random

import numpy as np
import pyarrow as pa
import pytest

from tallywood.llm import tokencount

ODD = ["", " ", "  ", "\n", "a\n\nb", " a", "a ", "\t\n \n", "▁x ▁▁ y", "<s> </s> <unk>", "café ﬁ Å 　z", "日本語", "a\0b\0", "\0", "x" * 5000, "ab " * 9000, "\U0001f600 ﻿ x", "|" * 40, "aaaa" * 300 + " b"]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, SentencePieceProcessor(model_file=path)


def checked(rows, whole, limit=4096):
    for r in rows:
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(whole.encode(text))), text[:80]
        assert r.over_limit == (r.n_tokens > limit)


def test_odd_texts(make_docs, model):
    texts = [None, *ODD, *ODD]
    docs = make_docs(texts, "n_tokens string")
    got = {r.doc_id: r for r in tokencount.token_counts(docs, entries=4).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((text or "").encode()), len(model[1].encode(text or ""))), repr(text)[:60]


def test_random_texts_and_tables_of_any_size(model):
    draw = random.Random(5)
    signs = " \n▁abcde.,\té中'|0"
    texts = ["".join(draw.choices(signs, [6, 1, 1] + [2] * 13, k=draw.randrange(120))) for _ in range(400)]
    column, behind = pa.array(texts), tokencount.Encoder(model[0])
    want = [len(x) for x in model[1].encode(texts)]
    assert tokencount.counts(column, None, behind).tolist() == want
    x, edges, _ = tokencount.cuts(column)
    parts = sorted({p for p in (x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)) if len(p) <= tokencount.PACKED})
    for n in (1, 7, len(parts)):
        table = tokencount.table_of(parts[:n], behind)
        assert tokencount.counts(column, table, behind).tolist() == want
        low, high, size = tokencount.packed(np.frombuffer(b"".join(parts[:n]), np.uint8), np.cumsum([0, *map(len, parts[:n])]))
        assert (table.find(low, high, size) >= 0).all()


def test_the_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHED", 10)
    behind = tokencount.Encoder(model[0])
    for k in range(20):
        parts = [f" w{k}{j}".encode() for j in range(7)] + [b" w00", b"y" * 100]
        assert behind.counts(parts).tolist() == behind.encoded(parts)
        assert len(behind.new) < 10 and b"y" * 100 not in behind.new


def test_the_frequent_are_found_in_spite_of_a_small_summary(spark, make_docs):
    draw = random.Random(1)
    texts = [" ".join(["often"] * 5 + ["also"] * 3 + [f"r{draw.randrange(10**6)}" for _ in range(10)]) for _ in range(300)]
    assert {b" often", b" also"} <= set(tokencount.frequent(make_docs(texts), entries=8))


def test_models_that_cannot_be_cut_are_refused(spark, make_docs, monkeypatch):
    monkeypatch.setattr(tokencount.Encoder, "fits", lambda self: False)
    with pytest.raises(ValueError, match="white space"):
        tokencount.token_counts(make_docs(["x"]))


def test_empty_table_and_repeated_rows(spark, make_docs):
    docs = make_docs(["a b", "c"])
    assert tokencount.token_counts(docs.where("false")).collect() == []
    assert tokencount.token_counts(docs.union(docs)).count() == 4
    out = tokencount.token_counts(docs.selectExpr("cast(null as string) as doc_id", "text"))
    assert [r.doc_id for r in out.collect()] == [None, None] and dict(out.dtypes)["n_tokens"] == "bigint"


def test_the_query(spark, model):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = tokencount.op13_token_counts(spark, sf).join(texts, "doc_id").collect()
    assert len(rows) == texts.count()
    checked(rows, model[1])
    assert any(r.over_limit for r in rows) and not all(r.over_limit for r in rows)
