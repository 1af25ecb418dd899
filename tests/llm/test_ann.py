import math

import numpy as np

from tallywood.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, class string"


def brute(rows, k, asks):
    fine, seen = [], set()
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) or len(v) != 16:
            continue
        v = np.array(v, np.float32).astype(float)
        if (i, v.tobytes()) not in seen:
            seen.add((i, v.tobytes()))
            fine.append((i, v))
    out = {}
    for q, v in fine:
        if asks(q):
            out[q] = sorted(((-float(v @ w), i) for i, w in fine if i != q))[:k]
    return out


def check(spark, rows, k, least, **options):
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA), lambda c: c % 5 == 0, k, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, k, lambda q: q % 5 == 0)
    assert set(got) <= set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(mine, mine[1:], strict=False))
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
    assert hits >= least * sum(map(len, want.values()))


def test_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODES", 300)
    monkeypatch.setattr(ann, "QUERIES", 50)
    rng = np.random.default_rng(0)
    v = rng.standard_normal((1000, 16)).astype(np.float32)
    v[200:400] = v[7]  # a hot vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1001, None), (1005, [0.0] * 16), (1010, [float("nan")] * 16), (1015, [None] * 16), (1020, [1.0]), (1025, []), (None, v[1].tolist()), (1030, [1e30] * 16), (5, v[5].tolist())]
    check(spark, rows, 10, 0.99)


def test_exact_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0] * 16) for i in range(40)]
    got = ann.nearest(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA), lambda c: c % 20 == 0, 20).collect()
    by = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in (0, 20)}
    assert by == {0: list(range(1, 21)), 20: list(range(20))}


def test_few_and_none(spark):
    check(spark, [(i, np.eye(16)[i].tolist()) for i in range(6)], 20, 1.0)
    assert ann.nearest(spark.createDataFrame([], SCHEMA), lambda c: c % 5 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((500, 64)), rng.standard_normal((40, 64))
    turn = ann.rotation(64, 512)
    packed, norm, correction = ann.encode(v, turn)
    estimate, off = ann.bounds(np.unpackbits(packed, axis=1, count=512).astype(np.float32), norm, correction, q, turn, 3.0)
    assert (np.abs(estimate - v @ q.T) <= off).mean() > 0.99


def test_cells_that_cannot_hold_a_neighbour_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODES", 40)
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((20, 16)) * 20
    rows = [(i, (middle[i % 20] + rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(800)]
    check(spark, rows, 10, 0.99)


def test_lengths_are_compared_among_themselves(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4 + i % 2).tolist()) for i in range(60)]
    table = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    got = ann.nearest(table, lambda c: c % 5 == 0, 5).collect()
    assert {(r.query_id % 2, r.vec_id % 2) for r in got} == {(0, 0), (1, 1)} and len(got) == 12 * 5
    for q, v in rows[::5]:
        near = sorted((-float(np.dot(np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float))), i) for i, w in rows if i != q and len(w) == len(v))[:5]
        assert {r.vec_id for r in got if r.query_id == q} == {i for _, i in near}
    many = spark.createDataFrame([(i, [1.0] * (i + 1), 0, "") for i in range(20)], SCHEMA)
    try:
        ann.nearest(many, lambda c: c % 5 == 0)
        raise AssertionError
    except ValueError:
        pass


def test_op6_recall(spark):
    """All queries of the small table against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    v = np.stack(table["embedding"]).astype(float)
    got = ann.op6_nearest_neighbours(spark, "/root/testdata/sf0.01").toPandas()
    hits = 0
    for n, q in enumerate(table["vec_id"]):
        if q % 20 == 0:
            near = sorted((-float(s), i) for s, i in zip(v @ v[n], table["vec_id"], strict=True) if i != q)[:20]
            hits += len({i for _, i in near} & set(got[got["query_id"] == q]["vec_id"]))
    assert hits >= 0.9 * len(got) and len(got) == 20 * (table["vec_id"] % 20 == 0).sum()
