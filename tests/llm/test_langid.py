import random
import zlib

import numpy as np
import pytest

from tallywood.llm import langid
from tallywood.llm._shared import fold

SCHEMA = "doc_id long, text string, lang string, score double"
ALPHABETS = {"aa": "abcde", "bb": "efghé", "cc": "漢字かな"}


def documents(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(ALPHABETS[k], k=rng.randint(2, 7))) for _ in range(rng.randint(3, 120))), k, 0.0) for i in range(n) for k in [rng.choice(list(ALPHABETS))]]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.ByteNetwork.fresh(["a", "b", "c"], 4, 1)
    windows = rng.integers(0, 20, (5, 7))
    windows[0, 5:] = langid.PAD
    target = np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(windows, target, np.ones(5))
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(5):
            i = tuple(rng.integers(0, s) for s in w.shape)
            kept = w[i]
            w[i] = kept + 1e-2
            up, _ = net.gradients(windows, target, np.ones(5))
            w[i] = kept - 1e-2
            down, _ = net.gradients(windows, target, np.ones(5))
            w[i] = kept
            assert (up - down) / 2e-2 == pytest.approx(g[i], abs=2e-4)


def test_held_out_accuracy_and_odd_texts(spark):
    rows = documents(400) + [(9001, None, "aa", 1.0), (9002, "", None, 1.0), (9003, "12 + 3 = 15!", "bb", 1.0), (9004, "abc", None, 1.0), (None, "abcd cab", "aa", 1.0), (7, "abc", "aa", 1.0), (7, "abc", "aa", 1.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = langid.learn(docs.where(fold("doc_id", 5) != 0), steps=150)
    assert net.languages == ["aa", "bb", "cc"]
    got = langid.identify(docs, net).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    held = [(i, k) for i, _, k, _ in rows[:400] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by[i].lang_pred == k for i, k in held) >= 0.97 * len(held) and len(held) > 40
    assert all(0 <= r.score <= 1 for r in got)


def test_every_byte_counts(spark):
    docs = spark.createDataFrame([(1, "abcde " * 100 + "漢字か " * 40000, None, 0.0)], SCHEMA)
    net = langid.learn(spark.createDataFrame(documents(200), SCHEMA), steps=100)
    assert langid.identify(docs, net).first().lang_pred == "cc"


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.learn(none) is None and langid.identify(none, None).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc", None, 0.0)], SCHEMA), None).first() == (1, "und", 0.0)
    one = spark.createDataFrame([(1, "abc", "aa", 0.0)], SCHEMA)
    assert langid.identify(one, langid.learn(one, steps=5)).first() == (1, "aa", 1.0)


def test_copies_of_a_text_take_one_place_of_the_sample(spark):
    rows = [("en", "one text of very many copies")] * 500 + [("en", f"another text, number {k}") for k in range(60)]
    for many in (40, 100):
        parts = [r.part for r in langid.sample_windows(spark.createDataFrame(rows, "lang string, text string"), many).collect()]
        assert len(parts) == len(set(parts)) == min(many, 61)


def test_the_sample_is_of_the_least_hashes(spark):
    rows = [("en", f"text {k} of a language with many texts") for k in range(3000)] + [("de", f"text {k}") for k in range(30)] + [(None, "x"), ("de", "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = langid.sample_windows(docs, 40, window=200)
    named = docs.where("lang is not null and text <> ''").selectExpr("lang", "text", "shiftrightunsigned(xxhash64(text), 1) as h").collect()
    want = {("de", r.text) for r in named if r.lang == "de"} | {("en", r.text) for r in sorted((r for r in named if r.lang == "en"), key=lambda r: r.h)[:40]}
    assert {(r.lang, r.part) for r in got.collect()} == want


def test_identify_as_a_plain_forward_pass(spark):
    """Every byte through the gates one by one, in windows, against the batched network."""
    net = langid.learn(spark.createDataFrame(documents(100), SCHEMA), steps=30)
    squash = lambda x: x / (1 + abs(x))

    def states(data, k):
        hidden = net.us[k].shape[1]
        h, out = np.zeros(hidden), []
        for byte in data:
            x, own = net.tables[k][:, byte].astype(float), net.us[k].astype(float) @ h
            z, r = (0.5 + 0.5 * squash(x[n * hidden : (n + 1) * hidden] + own[n * hidden : (n + 1) * hidden]) for n in (0, 1))
            fresh = squash(x[2 * hidden :] + r * own[2 * hidden :])
            h = z * h + (1 - z) * fresh
            out.append(h)
        return out

    texts = ["abc abd", "é aaa " * 40, "b", "xyz " * 33]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(i, t, None, 0.0) for i, t in enumerate(texts)], SCHEMA), net).collect()}
    for i, t in enumerate(texts):
        data, total = t.encode(), np.zeros(len(net.languages))
        for at in range(0, len(data), langid.WINDOW):
            window = list(data[at : at + langid.WINDOW])
            padded = window + [langid.PAD] * (langid.WINDOW - len(window))
            one, two = states(padded, 0), states(padded[::-1], 1)[::-1]
            for a, b in list(zip(one, two, strict=True))[: len(window)]:
                e = np.exp(net.v.astype(float) @ np.concatenate([a, b]) + net.c[:, 0])
                total += e / e.sum()
        total /= len(data)
        assert got[i].lang_pred == net.languages[int(total.argmax())] and got[i].score == pytest.approx(total.max(), abs=1e-4)


def test_windows_are_filled_up_with_what_is_no_byte():
    import pyarrow as pa

    windows, row = langid.windows_of(*langid.texts_of(pa.array(["abc", "", "d" * 70])), size=8)
    assert (windows != langid.PAD).sum() == 73 and row.tolist() == [0] + [2] * 9 and windows[0, :4].tolist() == [97, 98, 99, langid.PAD]
