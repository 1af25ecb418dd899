import random

import numpy as np
import pyarrow as pa

from tallywood.llm import quality
from tallywood.llm._words import texts_of

SCHEMA = "doc_id long, text string, quality int, stats string"


def texts(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 150))]
        good = rng.random() < 0.7
        out.append((i, " ".join(words) + "." if good else rng.choice([" | ".join(words), " ".join(words).upper() + "!!", "$$ ".join(words)]), int(good), ""))
    return out


def test_held_out_accuracy(spark):
    rows = texts(600)
    known = spark.createDataFrame([(i + 10_000, t, y, s) for i, t, y, s in rows[:450]] + [(1, "x", None, ""), (2, None, 1, ""), (3, "y", 7, "")], SCHEMA)
    model = quality.fit(quality.with_statistics(known).join(known.select("doc_id", "quality"), "doc_id"))
    docs = spark.createDataFrame(rows[450:] + [(7001, None, 1, ""), (7002, "", 0, ""), (7003, "word " * 60000, 0, ""), (None, "a b", 1, "")], SCHEMA)
    got = {r.doc_id: r.score for r in quality.score(quality.with_statistics(docs), model).collect()}
    assert len(got) == 154 and all(0 <= s <= 1 for s in got.values()) and got[7001] == got[7002]
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y, _ in rows[450:]) >= 0.95 * 150


def test_scores_do_not_depend_on_neighbours():
    rows = [t for _, t, _, _ in texts(50)] + ["", "é" * 9, "\n\n a\na", "x"]
    together = quality.statistics(*texts_of(pa.array(rows)))
    alone = np.concatenate([quality.statistics(*texts_of(pa.array([t]))) for t in rows])
    assert np.array_equal(together, alone)
    assert not together[50].any()


def test_isotonic():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 9, 40)
    p = rng.binomial(n, 0.5)
    edges, shares = quality.isotonic(np.arange(40.0), p, n)
    assert (np.diff(shares) >= 0).all() and (np.diff(edges) > 0).all()
    fitted = np.interp(np.arange(40.0), edges, shares)
    assert abs((fitted * n).sum() - p.sum()) < 1e-9
    # the least-squares non-decreasing fit, by its min-max formula
    means = [[p[i : j + 1].sum() / n[i : j + 1].sum() for j in range(40)] for i in range(40)]
    assert np.allclose(fitted, [max(min(means[i][j] for j in range(k, 40)) for i in range(k + 1)) for k in range(40)])


def test_nothing_to_learn_from(spark):
    stats = lambda rows: quality.with_statistics(spark.createDataFrame(rows, SCHEMA))
    model = quality.fit(spark.createDataFrame([], "stats array<double>, quality int"))
    assert [r.score for r in quality.score(stats([(1, "a", 1, "")]), model).collect()] == [0.5]
    assert quality.score(stats([]), model).count() == 0
