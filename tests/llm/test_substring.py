import random

import numpy as np
import pytest

from tallywood.llm import _link, substring
from tallywood.llm._words import NONSPACE, texts_of, words_of

SCHEMA = "doc_id long, text string"
LEAST = substring.LEAST


def windows(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + LEAST]) for i in range(len(w) - LEAST + 1)]


def brute(rows):
    """The words of every id and text that another document has in a run of LEAST equal words, and those that an earlier one has."""
    where = {}
    for i, t in {(i, t) for i, t in rows if i is not None}:
        for k, x in enumerate(windows(t)):
            where.setdefault(x, []).append((i, t, k))
    found, again = set(), set()
    for places in where.values():
        if len({i for i, _, _ in places}) > 1:
            for i, t, k in places:
                covered = {(i, t, k + n) for n in range(LEAST)}
                found |= covered
                if i > min(places)[0]:
                    again |= covered
    return found, again


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    text = lambda n: rng.choices(vocab, k=n)
    passages = [text(n) for n in (49, 52, 55, 57, 120, 400)]
    rows = []
    for i in range(60):
        w = text(rng.choice([0, 20, 140]))
        for p in rng.sample(passages, 2):
            w += [*p, *text(rng.choice([0, 1, 30]))]
        w = [x.upper() if rng.random() < 0.1 else x for x in w]
        # in one line, hard-wrapped, or any
        rows.append((i, "".join(x + rng.choice([" ", "\n", "  "]) if i % 3 == 0 else x + ("\n" if i % 3 == 1 and k % 9 == 8 else " ") for k, x in enumerate(w))))
    return rows + [(60, None), (61, ""), (62, "same " * 300), (63, "x " + "same " * 90), (64, "alone " * 200), rows[5], (7, rows[9][1]), (None, rows[4][1]), (65, "é " * 60), (66, "é\n" * 60)]


def test_runs_of_equal_words_as_brute_force(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    parts = {(r.doc_id, r.part): r.text for r in table.selectExpr("doc_id", "xxhash64(text) as part", "text").collect()}
    found, again = set(), set()
    for r in substring.repeated_passages(table).collect():
        t, first = parts[r.doc_id, r.part], parts[r.first_doc_id, r.first_part]
        a, b = t.lower().split()[r.word : r.word + r.n_words], first.lower().split()[r.first_word : r.first_word + r.first_n_words]
        assert len(a) == r.n_words >= LEAST and len(b) == r.first_n_words >= LEAST
        assert a == b or 100 * distance(a, b) <= 20 * max(len(a), len(b))
        assert r.removed == ((r.doc_id, r.part, r.word) != (r.first_doc_id, r.first_part, r.first_word)) and r.first_doc_id + r.removed <= r.doc_id
        covered = {(r.doc_id, t, r.word + n) for n in range(r.n_words)}
        found |= covered
        if r.removed:
            again |= covered
    want = brute(rows)
    # at a passage's end a copy other than the earliest may go on by a word or two
    assert len(want[1]) > 3000 and len(want[1] - again) <= 0.001 * len(want[1])
    # the earlier places are named where later ones begin; what the document of one word repeats within itself isn't
    assert len({x for x in want[0] - found if x[0] != 62}) <= 0.001 * len(want[0])
    assert {x[:2] for x in want[0]} <= {x[:2] for x in found}


def planted(rng, edits, base, count=60):
    """Documents in pairs that share one passage of 50 to 80 words, edited in the second; and the words it covers there."""
    word = lambda: f"v{rng.randrange(10**6)}"
    rows, at = [], []
    for k in range(count):
        p = [word() for _ in range(rng.randint(51, 80))]
        q = list(p)
        for _ in range(edits):
            x = rng.randrange(1, len(q) - 1)
            q[x : x + rng.choice([0, 1, 1])] = rng.choice([[word()], [word()], []])
        one, two = ([word() for _ in range(rng.randint(0, 60))] for _ in "ab")
        text = lambda w: "".join(x + ("\n" if rng.random() < 0.08 else " ") for x in w)
        rows += [(base + 2 * k, text(one + p + two)), (base + 2 * k + 1, text(two + q + one[:20]))]
        at.append((base + 2 * k + 1, len(two), len(q)))
    return rows + [(base + 10_000 + k, text([word() for _ in range(200)])) for k in range(60)], at


def test_recall_of_passages_inside_and_across_lines(spark):
    rng = random.Random(3)
    sets = [planted(rng, edits, edits * 100_000) for edits in range(4)]
    got = {}
    for r in substring.repeated_passages(spark.createDataFrame([x for rows, _ in sets for x in rows], SCHEMA), least=45).where("removed").collect():
        got.setdefault(r.doc_id, set()).update(range(r.word, r.word + r.n_words))
    for edits, (_, at) in enumerate(sets):
        caught = sum(len(got.get(i, set()) & set(range(a, a + n))) >= 0.8 * n for i, a, n in at)
        print(f"{edits} edits: {caught} of {len(at)}")
        assert caught >= 0.9 * len(at)
    assert not any(i % 100_000 >= 10_000 for i in got)


def test_what_stands_once_stays(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    p, u, v, w = text(60), text(70), text(80), text(90)
    rows = [(1, f"{p}\n{u}"), (2, p), (2, u.upper() + " " + v), (2, w), (None, p), (None, w), (3, f"{v} tail"), (3, f"{v} tail"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, k, "x", "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, inner_0 int, words string, part string")
    got = {r.inner_0: r for r in substring.remove_repeated_passages(docs).collect()}
    assert [got[k].text for k in range(10)] == [rows[0][1], "", v, w, p, w, "tail", "tail", None, ""]
    assert all(r.words == "x" and r.part == "y" for r in got.values()) and got[0].asDict().keys() == set(docs.columns)


def test_paragraphs_cover_all_words_and_begin_alike(spark):
    rng = random.Random(1)
    passage = [f"w{rng.randrange(50)}" for _ in range(200)]
    texts = ["", "one", " ".join(passage), "a b c " + " ".join(passage), "same " * 500, None, "é " * 31]
    data, offsets = texts_of(__import__("pyarrow").array(texts))
    words = words_of(data, offsets, NONSPACE)
    row, begin, n = substring.paragraphs(words, words.hashes())
    assert (begin == np.append(0, np.cumsum(n)[:-1])).all() and n.sum() == len(words.starts) and n.max() <= substring.MOST
    assert (np.searchsorted(words.first, begin, "right") - 1 == row).all()
    one, two = (set((begin[row == r] - words.first[r] - shift).tolist()) for r, shift in ((2, 0), (3, 3)))
    inside = set(range(substring.REACH, 200 - substring.REACH - 1 - substring.MOST))
    assert one & inside == two & inside and len(one & inside) > 5


def test_alignment():
    a = np.arange(100)
    b = np.concatenate([a[:30], [500], a[31:60], a[61:90], [501, 502], a[90:]])
    assert substring.align(a, b, [(10, 10)], 50, 80) == [(0, 100, 0, 101)]
    assert substring.align(a, np.arange(1000, 1100), [(10, 10)], 50, 80) == []
    assert substring.align(a, a[20:60], [(25, 5)], 50, 80) == [] and substring.align(a, a[20:75], [(25, 5)], 50, 80) == [(20, 75, 0, 55)]


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**substring.ROWS) ** substring.bands_for(0.8) >= 1 - substring.MISSED
    bands = substring.bands_for(0.8)
    a = np.arange(bands * substring.ROWS, dtype=np.uint16)[None]
    assert substring.band_keys(a).shape == (1, bands) and len(set(substring.band_keys(a)[0])) == bands


@pytest.mark.parametrize("buckets", [1, 7, 100_000])
def test_members_of_dealt_keys(spark, buckets):
    rng = np.random.default_rng(buckets)
    names = rng.integers(0, 1 << 64, 3000, np.uint64)
    # nodes that agree in their low or their high 32 bits
    nodes = np.concatenate([rng.integers(-(1 << 63), 1 << 63, 20), np.arange(10) << 32, np.arange(10)])
    key, node = names[rng.integers(0, 3000, 6000)], nodes[rng.integers(0, 40, 6000)]
    batches = [_link.dealt(key[a : a + 1500], node[a : a + 1500], buckets) for a in range(0, 6000, 1500)] + [_link.dealt(key[:0], node[:0], buckets)]
    rows = [(b, p) for x in batches for b, p in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert all(b < buckets and p for b, p in rows) and sum(len(p) for _, p in rows) == 16 * 6000
    plain = spark.createDataFrame(list(zip(key.view(np.int64).tolist(), node.tolist(), strict=True)), "key long, node long")
    of = {}
    for k, n in zip(key.view(np.int64).tolist(), node.tolist(), strict=True):
        of.setdefault(k, set()).add(n)
    want = sorted((k, n) for k, ns in of.items() if len(ns) > 1 for n in ns)
    assert sorted(map(tuple, _link.members(plain).collect())) == want
    assert sorted(map(tuple, _link.members_of(spark.createDataFrame(rows, "bucket int, pairs binary")).collect())) == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "few words")]])
def test_nothing(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    assert substring.repeated_passages(table).count() == 0
    assert [tuple(r) for r in substring.remove_repeated_passages(table).collect()] == rows


def test_op8_returns_documents(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: f"v{rng.random()}"
    one, two = [word() for _ in range(57)], [word() for _ in range(80)]
    line = lambda p: " ".join([*(word() for _ in range(40)), *p, *(word() for _ in range(43))])
    wrapped = lambda p, n: "\n".join(" ".join(p[k : k + n]) for k in range(0, len(p), n))
    texts = [line(one), line(one), wrapped(two, 9), "head\n" + wrapped(two, 11), line([])]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.word, r.n_words, r.first_doc_id, r.first_word, r.removed) for r in substring.op8_substring_dedup(spark, str(tmp_path)).collect())
    assert got == [(0, 40, 57, 0, 40, False), (1, 40, 57, 0, 40, True), (2, 0, 80, 2, 0, False), (3, 1, 80, 2, 0, True)]
