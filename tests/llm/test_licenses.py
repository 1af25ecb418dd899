import random
import re

from tallywood.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    return sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_phrases_as_brute_force(spark, make_docs):
    rng = random.Random(0)
    pool = ["GNU", "General", "public", "LICENSE", "apache", "CC", "by", "MIT", "license", "é", "the", "cc-BY", "mit\nlicense", "K", "İ"]
    texts = [rng.choice([" ", "-", ", "]).join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "...", "cc by " * 30000, "MIT License"]
    got = {r.doc_id: r for r in licenses.find_licenses(make_docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].n_words == len(words(t))
        assert [(p.place, p.label) for p in got[i].phrases] == base(t)


def test_templates_are_found_with_edits_and_elsewhere_not(spark, make_docs):
    rng = random.Random(1)
    noise = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    texts = []
    for _, text in licenses.TEMPLATES:
        w = licenses.words_of_template(text)
        texts.append(" ".join(noise(20) + w + noise(30)))
        texts.append(" ".join(noise(7) + w[: len(w) // 2] + (["odd"] if len(w) > 20 else []) + w[len(w) // 2 :]))
    texts += [" ".join(noise(300)), "all the rights reserved", " ".join(licenses.words_of_template(licenses.TEMPLATES[0][1])[::-1])]
    got = {r.doc_id: r for r in licenses.find_licenses(make_docs(texts)).collect()}
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        for i in (2 * k, 2 * k + 1):
            span = [s for s in got[i].spans if s.label == name and s.cover >= 0.85]
            assert span, (i, name, got[i].spans)
            if i % 2 == 0:
                assert any((s.first, s.last) == (20, 19 + len(licenses.words_of_template(text))) for s in span)
    assert [got[i].spans for i in range(2 * len(licenses.TEMPLATES), len(texts))] == [[], [], []]


def test_query_and_empty_table(spark, tmp_path, make_docs):
    assert licenses.find_licenses(make_docs([])).count() == 0
    make_docs(["a MIT license, CC BY and cc by", None, "All rights reserved."]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.op7_license_scan(spark, str(tmp_path)).collect()}
    assert got == {0: (8, 3, 1, 6, "cc-by,mit", "cc-by,mit", 1.0), 1: (0, 0, None, None, "", "", 0.0), 2: (3, 0, None, None, "", "reserved", 1.0)}
