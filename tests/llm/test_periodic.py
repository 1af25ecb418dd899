import hashlib
import random
import zlib

import numpy as np
import pytest

from tallywood.llm import periodic


def plain_runs(words, least=6, times=4):
    """Every period, every stretch of words that equal those a period on; the least period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("times", [2, 4])
@pytest.mark.parametrize("signs", [1, 2, 3, 7])
def test_runs_of_random_words(signs, times):
    draw = random.Random(signs)
    rows = [[b"%d" % draw.randrange(signs) for _ in range(draw.randrange(60))] for _ in range(150)]
    for _ in range(40):
        block = [b"%d" % draw.randrange(signs + 2) for _ in range(draw.randrange(1, 9))]
        rows.append(rows[draw.randrange(60)][:7] + (block * 9)[: draw.randrange(8, 60)] + rows[draw.randrange(60)][:9])
    runs, at = periodic.runs_of(rows, 6, times)
    for row, lo, hi in zip(rows, at[:-1], at[1:], strict=True):
        assert [tuple(r) for r in runs[lo:hi].tolist()] == plain_runs(row, 6, times)


def test_fibonacci_words_and_long_ones():
    a, b = b"x", b"xy"
    for _ in range(12):
        a, b = b, b + a
    word = [bytes([c]) for c in b]
    rows = [word, [b"x"] * 3000, [b"x", b"y", b"z"] * 1000 + [b"x"], [b"%d" % (i * i % 7) for i in range(500)]]
    for times in (2, 3, 4):
        runs, at = periodic.runs_of(rows, 2, times)
        assert [tuple(r) for r in runs[at[0] : at[1]].tolist()] == plain_runs(word, 2, times)
        assert runs[at[1] : at[2]].tolist() == [[0, 3000, 1]] and runs[at[2] : at[3]].tolist() == [[0, 3001, 3]]


def test_ends_of_nodes_in_few_rounds(monkeypatch):
    draw = np.random.default_rng(0)
    rows = [[b"%d" % x for x in draw.integers(0, 2, 200)], [b"x"] * 400 + [b"y"] + [b"x"] * 90]
    want = periodic.runs_of(rows, 2, 2)
    monkeypatch.setattr(periodic, "ROUNDS", 1)
    monkeypatch.setattr(periodic, "LISTED", 5)
    got = periodic.runs_of(rows, 2, 2)
    assert all((x == y).all() for x, y in zip(want, got, strict=True))


def test_the_tree_against_sorted_suffixes():
    draw = np.random.default_rng(1)
    signs = np.append(draw.integers(0, 3, 120), 3)
    tree = periodic.SuffixTree(signs)
    order = sorted(range(len(signs)), key=lambda i: signs[i:].tolist())
    assert tree.leaf.tolist() == order
    for k in range(1, len(order)):
        a, b = signs[order[k - 1] :], signs[order[k] :]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        assert tree.depth[k] == (differ[0] if len(differ) else m)


def test_odd_texts_and_rows(spark, make_docs):
    texts = [None, "", "  \n", "a a a a a a", "a\ta\na\x0ba\x0ca\ra", "a\xa0a a a a a a a", "b " * 5, "x y " * 4 + "x z", "ab cd " * 40000 + "end"]
    docs = make_docs(texts, "runs string")
    rows = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    for i, t in enumerate(texts[:-1]):
        words = (t or "").encode().split()
        assert (rows[i].n_words, [tuple(r) for r in rows[i].runs]) == (len(words), plain_runs(words)), t
    assert rows[3].collapsed == "a" and rows[7].collapsed == "x y z" and rows[8].collapsed == "ab cd end" and rows[0].collapsed == ""
    assert periodic.periodic_runs(docs.where("false")).collect() == []
    assert periodic.periodic_runs(docs.union(docs)).count() == 2 * len(texts)
    assert [r.doc_id for r in periodic.periodic_runs(docs.limit(1).selectExpr("cast(null as long) as doc_id", "text")).collect()] == [None]
    nothing = periodic.with_periods(docs.selectExpr("cast(null as long) as doc_id", "'a b' as text")).first()
    assert nothing.text == "a b"
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=1)


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in periodic.op11_periodic_runs(spark, sf).collect()}
    assert got == {plain_digest(*r) for r in docs}
    assert sum(r[1] > 0 for r in got) > 10
