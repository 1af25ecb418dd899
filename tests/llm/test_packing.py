import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallywood.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "It's  the\nEnd\t of it, isn't it?", "é é ŉ İstanbul KK ﬁne ǅ", "x" * 9000, "a b " * 5000, "<|endoftext|> A<|startoftext|>b", "漢字 かな 42 ½ ² ٣", "\x1c\x85 a b ', 's 're"]


def test_ids_are_those_of_the_whole_tokenizer():
    whole, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    pool = "abcXYZéÀßñ'’.,!?<|>09½ªº¹\n\t -_sStTrŔ"
    rng = random.Random(3)
    for text in [t or "" for t in ODD] + ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(3000)]:
        assert words.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    words, whole = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    text = " ".join(f"word{i % 37} the" for i in range(300))
    assert words.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(words.part_ids) <= 10 and len(words.part_ids.old) <= 10


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(20)}
    slots = {}
    for length, r0, r1, first, per, at in packing.plan(histogram, 64):
        for r in range(r0, r1):
            assert (length, r) not in slots
            slots[length, r] = (first + (r - r0) // per, at + (r - r0) % per * length)
    assert set(slots) == {(n, r) for n, c in histogram.items() for r in range(c)}
    by = {}
    for (n, _), (s, at) in slots.items():
        by.setdefault(s, []).append((at, n))
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    # no more than best-fit decreasing over the single pieces
    bins = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(64)
            fit = len(bins) - 1
        bins[fit] -= n
    assert len(by) <= len(bins)


def test_pack_documents(spark, make_docs):
    got = packing.pack_documents(make_docs(ODD + ["same text"] * 30), PATH, 64).toPandas()
    whole = Tokenizer.from_file(PATH)
    for i, text in enumerate(ODD + ["same text"] * 30):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        rows = got[got.doc_id == i].sort_values("piece")
        assert rows.piece.tolist() == list(range(-(-len(ids) // 64)))
        for r in rows.itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * 64 and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1


def test_empty_table(spark, make_docs):
    assert packing.pack_documents(make_docs([]), PATH).count() == 0
