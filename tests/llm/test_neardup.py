import random
import re

import numpy as np
import pytest

from tallywood.llm import _shared, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(texts, width, percent):
    sets = [shingle_set(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_as_brute_force(spark, make_docs, width, percent, monkeypatch):
    monkeypatch.setattr(neardup._link, "BLOCK_SETS", 20)
    rng = random.Random(width)
    texts = []
    for size in (2, 3, 40, 150):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([60, 200]))]
        texts += [" ".join(edited(rng, base, rng.randrange(6))) for _ in range(size)]
    texts += ["a b", "A  B", "a", "", None, " \t\n", "x y z", "X y\nz", "é É", "É é", "long " * 3000, "long " * 2999, " ".join(f"k{i}" for i in range(20000)), " ".join(f"K{i}" for i in range(20000)) + " end"]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(make_docs(texts), width, percent).collect()}
    assert len(got) == len(texts)
    for i, (n, root) in enumerate(brute(texts, width, percent)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, i == root)


def test_signature_distance_is_guaranteed():
    rng = np.random.default_rng(0)
    chunks = neardup.chunks_for(0.85)
    for d in range(2 * chunks):
        a = rng.integers(0, 1 << 16, (50, neardup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        for r in range(50):
            b[r, rng.choice(neardup.SYMBOLS, d, replace=False)] ^= 1
        ka, kb = neardup.chunk_keys(a, chunks), neardup.chunk_keys(b, chunks)
        assert (ka == kb).any(axis=1).all()


def test_ids_whose_digests_agree_are_linked(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(201)]
    # two ids of one 32-bit hash
    ids = [-3965417102674106237, -6054336684747022631]
    rows = [(ids[0], " ".join(words)), (ids[1], " ".join([*words[:-1], "other"]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.component_id for r in got} == {min(ids)}


def test_words_of_known_collisions_differ(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))  # one hash with it by any polynomial modulo 2^64
    rows = [(1, f"x {word} y"), (2, f"x {other} y"), (3, f"X {word.upper()} y")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_hashes_tell_words_of_all_lengths_apart():
    words = [b"a" * k for k in range(1, 40)] + [b"a" * k + b"\0" for k in range(1, 40)] + [b"b" + b"a" * k for k in range(40)]
    data = b" ".join(words)
    found = neardup.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), neardup.NONSPACE)
    hashes = found.hashes()
    assert len(hashes) == len(words) == len(set(hashes.tolist()))
    again = neardup.words_of(np.frombuffer(data.upper(), np.uint8), np.array([0, len(data)]), neardup.NONSPACE)
    assert (again.hashes() == hashes).all()


def test_odd_rows(spark):
    schema = "doc_id long, text string, node string, component string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "one two three four five six", "", ""), (4, "one two three four five six", "", ""), (4, "one two three four five six", "", ""), (2, "One two three four  five six", "", "")]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.component for r in _shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert _shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
