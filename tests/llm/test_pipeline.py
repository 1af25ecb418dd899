import random

from tallywood.llm import langid
from tallywood.llm import pipeline as corpus_pipeline
from test_decontam import brute as contaminated
from test_linededup import brute as cut_lines
from test_neardup import brute as near


def tables(spark, path, texts):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", None]) if t else None, "s", len(t or ""), "x", 1, "y", "z", 2, "w") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, places string, _id long, _places string, _chunks string, removed_lines int, inner_0 string").write.parquet(f"{path}/documents.parquet")
    return {i: t for i, t in enumerate(texts)}


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


def test_each_stage_against_a_plain_version(spark, tmp_path):
    rng = random.Random(0)
    vocab = [f"word{k}" for k in range(300)]
    passage = "\n".join(words(rng, 12, vocab) for _ in range(9))
    items = [(k, words(rng, 30, vocab)) for k in range(4)]
    texts = ["\n".join(words(rng, 15, vocab) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    texts += [t + "\n" + passage for t in texts[:10]] + [t.replace("word7 ", "word8 ") for t in texts[:10]] + [items[0][1] + " and " + texts[11]] + ["12345 67 !!", "", None] + [texts[3]] * 2
    docs = tables(spark, str(tmp_path), texts)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in now.collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "best_fit_packing":
            break
        assert now.columns == columns
        assert not now.where("not (places = 'x' and _id = 1 and _places = 'y' and _chunks = 'z' and removed_lines = 2 and inner_0 = 'w')").count()
        after, ids = {r.doc_id: r.text for r in now.collect()}, sorted(before)
        if name == "language_id":
            want = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            want = {i: t for i, (t, n) in zip(ids, cut_lines([(i, before[i]) for i in ids]), strict=True) if not n or t.strip()}
        elif name == "near_dedup":
            want = {i: before[i] for k, (i, (_, root)) in enumerate(zip(ids, near([before[i] for i in ids], 5, 80), strict=True)) if root == k}
        else:
            want = {i: before[i] for i, found in zip(ids, contaminated([before[i] for i in ids], [(str(n), t) for n, t in items]), strict=True) if not found[3]}
        assert after == want and len(after) <= len(before)
    packed = now.collect()
    assert {r.doc_id for r in packed} == set(after)
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 2048) + 1
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect())
    assert whole == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_empty_table(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert langid.UNKNOWN == "und"


def test_the_script_has_the_same_stages():
    import corpus_pipeline as script

    assert script.STAGES is corpus_pipeline.STAGES and script.run is corpus_pipeline.run


def test_documents_of_no_one_language_go(spark, tmp_path):
    rng = random.Random(1)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    text = lambda kind, n: " ".join("".join(rng.choices(kinds[kind], k=5)) for _ in range(n))
    rows = [(i, text(kind, 60), kind) for i, kind in enumerate(["aa", "bb"] * 100)]
    rows += [(1000, text("aa", 60) + " " + text("bb", 60), "aa"), (1001, "1234 5678", None), (1002, "", "aa"), (1003, None, "bb"), (None, "12", None), (None, text("aa", 9), "aa"), (1004, "ab vw", None)]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert left == {*range(200), None, 1004}


def test_repeated_rows_stay_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m"), (None, "x y"), (None, "x z")], "doc_id long, text string")
    left = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert left == [(0, "x y"), (0, "x z"), (1, "a b c d e f g"), (3, "h i j k l m")]
