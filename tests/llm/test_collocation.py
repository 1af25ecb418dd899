import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallywood.llm import collocation

SCHEMA = "lang string, text string, phrase string, n string"


def plain(rows, least=10, longest=3, percent=50, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        more = Counter()
        for p, n in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    more[p[i : i + m]] = max(more[p[i : i + m]], n)
        found = []
        for p, a in candidates.items():
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * more[p] < percent * a or not more[p]:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def some_rows(seed, n, words=12):
    draw = random.Random(seed)
    known = [f"w{k}" for k in range(words)] + ["É", "é", "new york", "Of The", "a\tb", "x\x1cy", "-"]
    return [(draw.choice(["en", "fr", None, ""]), "".join(draw.choice(known) + draw.choice([" ", " ", " ", "  ", ". ", "\n", "\r", ", "]) for _ in range(draw.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize(("least", "longest", "percent", "top"), [(10, 3, 50, 2000), (2, 3, 80, 7), (3, 5, 50, 2000), (2, 2, 50, 5)])
def test_as_brute_force(spark, least, longest, percent, top):
    rows = some_rows(longest, 120) + [("en", None), ("en", ""), ("en", " .. ;"), (None, "und und " * 10)]
    docs = spark.createDataFrame([(a, b, "p", "n") for a, b in rows], SCHEMA)
    got = collocation.collocations(docs, least, longest, percent, top)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, longest, percent, top)


def test_small_shards_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocation, "SHARD", 50)
    rows = some_rows(1, 30) + [("en", " ".join(f"w{i * i % 11}" for i in range(700))), ("en", "w1 w4. w9 w5, " * 100)]
    docs = spark.createDataFrame([(a, b, "p", "n") for a, b in rows], SCHEMA)
    assert sorted(map(tuple, collocation.collocations(docs, 3).collect())) == plain(rows, 3)


def test_long_texts_are_read_in_parts_that_end_with_pieces(monkeypatch):
    draw = random.Random(2)
    text = "".join(draw.choice(["ab ", "c. ", "dé\n", "Ef, "]) for _ in range(2000)) + "x " * 300
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array([text, None, "y z"])], ["lang", "text"])

    def pieces():
        out = defaultdict(list)
        for k, (_, words, piece) in enumerate(collocation._read([batch])):
            for w, p in zip(words, piece.tolist(), strict=True):
                out[k, p].append(w)
        return k, list(out.values())

    (one, whole) = pieces()
    monkeypatch.setattr(collocation, "TOGETHER", 100)
    (many, parts) = pieces()
    assert one == 0 and many > 20 and parts == whole
    assert whole == [p.encode().lower().split() for p in re.split(r"[.,\n]", text + "\n\ny z") if p.split()]


def test_rare_words_cut_but_do_not_decide(spark, monkeypatch):
    rows = [("en", f"one two rare{i} three four") for i in range(30)] + [("en", "rare1 three")]
    docs = spark.createDataFrame([(a, b, "p", "n") for a, b in rows], SCHEMA)
    want = plain(rows)
    assert sorted(map(tuple, collocation.collocations(docs).collect())) == want
    monkeypatch.setattr(collocation, "frequent", lambda words: collocation._Filter({0: b"\xff" * (collocation.BLOCK // 8)}, collocation.BLOCK))  # full, so all pass
    assert sorted(map(tuple, collocation.collocations(docs).collect())) == want


def test_the_filter_passes_all_frequent_phrases(spark):
    rows = [(lang, f"w{i}é x{i}") for lang in ("en", "de", "") for i in range(3000)]
    kept = collocation.frequent(spark.createDataFrame(rows, "lang string, phrase string"))

    def passes(lang, words, more):
        return kept.passes(collocation.longer(collocation.word_hashes(lang, words), collocation.word_hashes(lang, more)))

    for lang in ("en", "de", ""):
        assert passes(lang, [f"w{i}é".encode() for i in range(3000)], [b"x%d" % i for i in range(3000)]).all()
    assert passes("en", [f"w{i}é".encode() for i in range(3000)], [b"x%d" % (i + 1) for i in range(3000)]).mean() < 0.02
    none = collocation.frequent(spark.createDataFrame([], "lang string, phrase string"))
    assert not none.passes(collocation.word_hashes("en", [b"x"])).any()


def test_automaton_states_are_classes_of_end_places():
    draw = random.Random(3)
    for depth in (1, 2, 3, 4):
        words = np.array([draw.choice([0, 1, 1, 2, 3]) for _ in range(200)])
        places = defaultdict(set)
        for i in range(len(words)):
            for m in range(1, depth + 1):
                if i - m + 1 >= 0 and (words[i - m + 1 : i + 1] > 0).all():
                    places[tuple(words[i - m + 1 : i + 1].tolist())].add(i)
        classes = defaultdict(set)
        for p, at in places.items():
            classes[frozenset(at)].add(p)
        a = collocation.Automaton(words, depth)
        got = {}
        for k in range(len(a.row)):
            sizes = range(a.shortest[k], a.longest[k] + 1)
            got[k] = {tuple(a.before[a.row[k], :m][::-1].tolist()) for m in sizes}
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))
        for k, own in got.items():
            assert a.places[k] == len(places[next(iter(own))])
            shorter = min(own, key=len)[1:]
            assert (a.link[k] == -1) if not shorter else shorter in got[a.link[k]]
        for m in range(1, depth + 1):
            rows, n = a.substrings(m)
            assert dict(zip(map(tuple, rows.tolist()), n.tolist(), strict=True)) == {p: len(at) for p, at in places.items() if len(p) == m}
    assert len(collocation.Automaton(np.zeros(0, np.int64), 3).row) == 0 and len(collocation.Automaton(np.zeros(4, np.int64), 3).row) == 0


def test_exact_beyond_64_bits(spark):
    row = spark.sql("select cast(3000000000000000 as decimal(16,0)) as a").selectExpr("(cast(1000000 as decimal(7,0)) * (a * a)) div (a * a) as s").first()
    assert row.s == 1000000


def test_empty_tables_and_types(spark):
    docs = spark.createDataFrame([], SCHEMA)
    out = collocation.collocations(docs)
    assert out.collect() == [] and dict(out.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")
    assert pa.types.is_string(out.toArrow().schema.field("phrase").type)


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(map(tuple, collocation.op12_phrase_collocations(spark, sf).collect())) == plain(rows)
