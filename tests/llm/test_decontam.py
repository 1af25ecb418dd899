import hashlib
import random
import re

import pytest

from tallywood.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = WORD.findall(lower(text or ""))
        for i in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(name)
    out = []
    for text in docs:
        w, hit, names = WORD.findall(lower(text or "")), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    names |= windows[k]
        out.append((len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize(("pass_bytes", "part_words"), [(1 << 20, 50_000), (200, 50_000), (1 << 20, 15)])
def test_as_brute_force(spark, make_docs, pass_bytes, part_words, monkeypatch):
    monkeypatch.setattr(decontam, "PART_WORDS", part_words)
    rng = random.Random(5)
    vocab = ["the", "of", "a", "É", "x1", "Über", "42"]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(str(i), " ".join(words(rng.choice([1, 2, 5, 12, 13, 14, 40])))) for i in range(12)] + [("n", None), ("e", "..."), ("z", "zeta eta")]
    texts = [", ".join(words(rng.randrange(400))) for _ in range(20)] + [items[k][1].upper() + "! " + " q".join(words(30)) for k in range(8)]
    texts += [None, "", "zeta-ETA", "Zeta  eta " * 4000, " ".join(["w"] * 700 + items[3][1].split())]
    bench = spark.createDataFrame([(n, t, "y") for n, t in items], "item_id string, text string, hits string")
    got = decontam.contaminated(decontam.find_passages(make_docs(texts), bench, pass_bytes=pass_bytes)).orderBy("doc_id").collect()
    for r, want in zip(got, brute(texts, items), strict=True):
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == want


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_passages(make_docs([]), none).count() == 0
    row = decontam.contaminated(decontam.find_passages(make_docs(["a b"]), none)).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_memory_of_a_pass():
    """8 MB of benchmark take well under 500 MB on the driver, and about ten times the text in a task."""
    import pickle
    import tracemalloc

    rng = random.Random(0)
    vocab = [f"word{k}" for k in range(20_000)]
    items = [(str(i), " ".join(rng.choices(vocab, k=1000))) for i in range(950)]
    assert 8e6 < sum(len(t) for _, t in items) < 1e7
    tracemalloc.start()
    patterns, names = decontam.compile_patterns(items, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and len(pickle.dumps((patterns, names))) < 120e6


def test_ten_passes_are_ten_jobs(spark, make_docs):
    rng = random.Random(9)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(40)]
    texts = [f"{rng.random()} {items[k]} {items[-k]} end" for k in range(30)] + [None, "", "nothing here", f"again {items[3]}", f"again {items[3]}"]
    bench = spark.createDataFrame([(f"i{k:02d}", t) for k, t in enumerate(items)], "item_id string, text string")
    size = sum(map(len, items)) // 10 + 1
    many = decontam.find_passages(make_docs(texts, "digest string"), bench, pass_bytes=size)
    # one pass and what puts the passes together, whatever their number
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    one = decontam.find_passages(make_docs(texts), bench)
    key = lambda r: repr(r)
    assert sorted(many.collect(), key=key) == sorted(one.collect(), key=key)
    assert sum(len(r.hits) > 0 for r in one.collect()) == 32
