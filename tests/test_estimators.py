import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywood.functions import special
from tallywood.operators import contfrac, coverage, extrapolate, histogram, moments, rarefy
from tallywood.plans import cli, report

# A truncated published histogram, multiplicities 1 to 10, and its number of distinct keys.
RECEPTORS = (433541, 56447, 13030, 4120, 2841, 1981, 1338, 970, 814, 632)
RECEPTORS_DISTINCT = 520_315
SMALL = {1: 4.0, 2: 3.0, 3: 1.0}


def frame(spark, bins):
    return spark.createDataFrame(list(bins.items()), "multiplicity long, n_keys double")


def long_tail(n=40, first=4000.0):
    return {j: float(round(first / j**1.7)) for j in range(1, n + 1)}


def test_ln_gamma(spark):
    x = [0.5, 1, 2, 3.7, 10, 1000, 1e6, 1e9]
    spark_values = [r[0] for r in spark.createDataFrame([(v,) for v in map(float, x)], "x double").select(special.ln_gamma("x")).collect()]
    assert np.allclose(spark_values, [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    assert np.allclose(special.ln_gamma_np(np.array(x)), spark_values, rtol=1e-14, atol=1e-13)
    special.register_functions(spark)
    assert spark.sql("select ln_gamma(5D), choose_ratio(10D, 3D, 8D)").first() == pytest.approx((math.log(24), 0.0))


def test_histogram_of_observations(spark):
    rows = spark.createDataFrame([(k,) for k in "aabcccdd"], "k string")
    assert {r.multiplicity: r.n_keys for r in histogram.histogram(rows, ["k"]).collect()} == {1: 1.0, 2: 2.0, 3: 1.0}
    counts = spark.createDataFrame([(1.0,), (2.9,), (0.0,), (0.4,), (None,)], "count double")
    assert {r.multiplicity: r.n_keys for r in histogram.histogram_of_counts(counts).collect()} == {1: 1.0, 2: 1.0}
    with pytest.raises(Exception, match="negative count"):
        histogram.histogram_of_counts(spark.createDataFrame([(-1.0,)], "count double")).collect()


def test_summary_terms_and_gates(spark):
    hist = frame(spark, SMALL | {5: 2.0})
    assert histogram.summary(hist).first() == (23.0, 10.0, 4, 5, 4.0)
    assert histogram.usable_terms(hist).first() == (4, 2)
    assert histogram.gate(frame(spark, SMALL)).first().status == "too_shallow"
    assert histogram.gate(frame(spark, {1: 1.0, 2: 9.0})).first().status == "saturated"
    assert histogram.gate(frame(spark, long_tail())).first().status == "ok"


def test_rarefaction_properties(spark):
    hist = frame(spark, long_tail())
    total = int(histogram.summary(hist).first().total)
    got = rarefy.rarefaction(hist, spark.createDataFrame([(n,) for n in (1, total // 3, total // 2, total)], "n long"), compat="exact").orderBy("n").collect()
    y = [r.expected_distinct for r in got]
    assert y[0] == pytest.approx(1, abs=1e-6) and y[-1] == sum(long_tail().values())
    assert y == sorted(y)
    dense = contfrac.Histogram.of(*map(list, zip(*long_tail().items(), strict=True)))
    assert contfrac.rarefied(dense, np.array([r.n for r in got]), "exact") == pytest.approx(y, rel=1e-9)
    with pytest.raises(ValueError):
        rarefy.grid(hist, 0)


def test_quotient_difference_gives_the_series_back():
    rng = np.random.default_rng(0)
    for degree in range(2, 9):
        series = rng.uniform(1, 9, degree) * (-1.0) ** np.arange(degree)
        for diagonal in (0, 1, -1):
            f = contfrac.Fraction.of(series, diagonal if degree > 3 else 0)
            t = 1e-4
            assert f(np.array([t]))[0] == pytest.approx(float(series @ t ** np.arange(degree)), abs=1e3 * t**degree + 1e-11)
    assert contfrac.Fraction.of(series).truncated(99) is None


def test_stability():
    assert contfrac.stable(np.array([0, 1, 1.5, 1.75]))
    for bad in ([], [0, 1, 0.5], [0, 1, 3], [0, np.nan], [-1, 0], [0, np.inf]):
        assert not contfrac.stable(np.array(bad, float))


def test_published_bound(spark):
    hist = np.array([0.0, *RECEPTORS])
    value, points = moments.richness(hist, distinct=RECEPTORS_DISTINCT)
    assert round(value, 1) == 2969646.3 and points == 2
    small = extrapolate.quick_bound(frame(spark, SMALL)).first()
    assert small.estimate >= 8


def test_quadrature_integrates_moments():
    nodes, weights = np.array([0.3, 1.2, 4.0]), np.array([0.5, 0.3, 0.2])
    m = np.array([(weights * nodes**r).sum() for r in range(6)])
    assert moments.definite(m, 5) == 3
    x, w = moments.rule(m, 3)
    assert x == pytest.approx(nodes) and w == pytest.approx(weights)


def test_curves_and_limits(spark):
    bins = {j: float(h) for j, h in enumerate([20_000, 7000, 3200, 1700, 1000, 640, 420, 290, 200, 140], 1)}
    hist = frame(spark, bins)
    quick = extrapolate.quick_curve(hist, 10_000, 1_000_000).orderBy("x").collect()
    y = np.array([r.expected_distinct for r in quick])
    assert quick[0].status == "ok" and (np.diff(y) >= 0).all()
    curve = extrapolate.lc_extrap(hist, 20_000, 400_000, replicates=10).orderBy("x").collect()
    assert [r.x for r in curve] == [20_000.0 * k for k in range(1, 20)]
    assert all(r.lower <= r.median <= r.upper for r in curve)
    one = extrapolate.bootstrap_curves(hist, 20_000, 100_000, replicates=4).orderBy("attempt").collect()
    assert one == extrapolate.bootstrap_curves(hist.repartition(5), 20_000, 100_000, replicates=4).orderBy("attempt").collect()
    with pytest.raises(ValueError, match="too shallow"):
        extrapolate.lc_extrap(frame(spark, SMALL), 10, 100)
    assert [r.status for r in extrapolate.quick_curve(frame(spark, SMALL), 10, 100).collect()] == ["too_shallow"]


def test_percentiles_are_numpys(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=101)
    got = extrapolate.percentile_limits(spark.createDataFrame([(float(x),) for x in v], "y double"), "y").first()
    assert tuple(got) == pytest.approx(tuple(np.quantile(v, [0.5, 0.025, 0.975])))


def test_bound_with_resampling(spark):
    row = extrapolate.bound_pop(frame(spark, long_tail()), replicates=30).first()
    assert row.lower <= row.median <= row.upper and row.median > sum(long_tail().values())


def test_convergence(spark):
    flat = [("a", float(x), 100 - 50 / x) for x in range(1, 30)] + [("b", 1.0, 1.0), ("b", 2.0, 1.1)] + [("c", float(x), 9.0 * x) for x in range(5)]
    got = extrapolate.converged(spark.createDataFrame(flat, "s string, x double, y double"), ["s"]).collect()
    assert {r.s: r.converged for r in got} == {"a": True, "b": False, "c": False}


def test_bins(spark):
    rows = spark.createDataFrame([("c", 3, 47, "a"), ("c", 11, 19, "b"), ("d", 10, 30, "c")], "chrom string, start long, end long, name string")
    floor = {(r.chrom, r.bin): r.n for r in coverage.floor_bins(rows, 10).groupBy("chrom", "bin").agg(F.count("*").alias("n")).collect()}
    assert floor == {("c", 0): 1, ("c", 1): 1, ("c", 2): 1, ("c", 3): 1, ("d", 1): 1, ("d", 2): 1}
    with pytest.raises(Exception, match="wider than the limit"):
        coverage.floor_bins(rows, 10, max_width=20).collect()
    many = spark.range(4000).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 25).alias("end"))
    bins = coverage.hashed_bins(many, 10, ["start"]).count()
    assert abs(bins - 4000 * 2.5) < 300
    again = coverage.hashed_bins(many.repartition(7), 10, ["start"]).groupBy("bin").count().orderBy("bin").collect()
    assert again == coverage.hashed_bins(many, 10, ["start"]).groupBy("bin").count().orderBy("bin").collect()
    reads = spark.createDataFrame([("c", 0, "ACGTNNNNNNACGTACGTAC")], "chrom string, start long, seq string")
    assert {r.bin for r in coverage.base_bins(reads, 10, ["start"]).collect()} >= {1}
    assert spark.createDataFrame([("10M2I5D3S7=1X4N",)], "c string").select(coverage.reference_length(F.col("c"))).first()[0] == 27


def test_six_significant_digits(spark):
    values = [0.0, 1.0, 99910.0, 893871.0, 999999.4, 1e6, 1234567.0, 12.5, 0.25, 123.4567]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(report.general(F.col("v"))).collect()]
    assert got == ["%g" % v for v in values]


def test_command_line(spark, tmp_path):
    path = tmp_path / "h.txt"
    path.write_text("".join(f"{j}\t{int(h)}\n" for j, h in long_tail().items()))
    lines = cli.run(spark, ["c_curve", "-H", "-s", "2000", str(path)])
    assert lines[0] == "total_reads\tdistinct_reads" and lines[1] == "0\t0" and lines[2].startswith("2000\t")
    assert cli.run(spark, ["bound_pop", "-Q", "-H", str(path)])[0] == "quadrature_estimated_unobs\tn_points"
    bed = tmp_path / "r.bed"
    bed.write_text("chr1\t1\t30\tx\t0\t+\nchr1\t1\t40\ty\t0\t+\nchr2\t5\t9\tz\t0\t-\n")
    assert cli.run(spark, ["c_curve", "-s", "1", str(bed)])[1:] == ["0\t0", "1\t2", "2\t2", "3\t2"]
    assert cli.run(spark, ["c_curve", "-P", "-s", "3", str(bed)])[-1] == "3\t3"


# A published histogram of duplicate counts, and its rarefaction curve in steps of 100,000.
READS = {1: 982419, 2: 6060, 3: 214, 4: 63, 5: 32, 6: 21, 7: 14, 8: 9, 9: 6, 10: 3, 11: 6, 12: 2, 13: 2, 14: 2, 15: 3, 16: 2, 24: 2, 31: 1}
READS_CURVE = (99910, 199638, 299216, 398655, 497958, 597127, 696168, 795082, 893871)


def test_published_rarefaction(spark):
    hist = frame(spark, {j: float(h) for j, h in READS.items()})
    lines = report.rarefaction(rarefy.rarefaction_curve(hist, 100_000))
    assert lines == ["total_reads\tdistinct_reads", "0\t0", *(f"{100_000 * k}\t{y}" for k, y in enumerate(READS_CURVE, 1))]
    exact = rarefy.rarefaction_curve(hist, 100_000, compat="exact").orderBy("n").first().expected_distinct
    assert exact == pytest.approx(99901.3627, abs=0.05)


def test_a_multiplicity_of_any_size(spark):
    """One key seen 1e12 times costs a bin, not 1e12 of them."""
    rows = [(1, 4000.0), (2, 1500.0), (3, 700.0), (4, 380.0), (5, 200.0), (6, 110.0), (10**12, 1.0)]
    hist = spark.createDataFrame(rows, "multiplicity long, n_keys double")
    got = extrapolate.quick_curve(hist, 0.5, 3, in_totals=True, defects=True).collect()
    assert [r.status for r in got] == ["ok"] * len(got) and len(got) >= 4
    bound = extrapolate.quick_bound(hist).first()
    assert bound.estimate > 6891 and bound.n_points > 0
    assert len(extrapolate.resample(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), 1, 2).j) <= 7


def test_percentile_limits_are_those_of_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(x)) for k, n in ((0, 1), (1, 2), (2, 101), (None, 40)) for x in rng.normal(size=n)] + [(2, None), (3, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (r.median, r.lower, r.upper) for r in extrapolate.percentile_limits(df, "v", ["k"], 0.9).collect()}
    for k in (0, 1, 2, None):
        own = [v for g, v in rows if g == k and v is not None]
        assert got[k] == pytest.approx(np.quantile(own, [0.5, 0.05, 0.95]), abs=1e-12)
    assert got[3] == (None, None, None) and len(got) == 5
    assert extrapolate.percentile_limits(df.where("false"), "v", ["k"]).collect() == []


def most_rows_of_a_stage(spark, df):
    """Runs ``df``; its rows, and the most rows that a stage of it read by shuffle."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    empty = lambda: spark.sparkContext._jvm.java.util.ArrayList()
    stages = lambda: store.stageList(empty(), False, False, gateway.new_array(gateway.jvm.double, 0), empty())
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    done = stages()
    return rows, max(s.shuffleReadRecords() for i in range(done.size()) if (s := done.apply(i)).stageId() not in known)


def test_percentile_limits_move_few_rows_of_a_large_group(spark):
    values = spark.range(0, 400_000, 1, 4).selectExpr("cast(id % 2 as int) as k", "cast(xxhash64(id) % 1000003 as double) as v")
    got, moved = most_rows_of_a_stage(spark, extrapolate.percentile_limits(values, "v", ["k"]))
    pdf = values.toPandas()
    for r in got:
        assert (r.median, r.lower, r.upper) == pytest.approx(tuple(np.quantile(pdf.v[pdf.k == r.k], [0.5, 0.025, 0.975])), abs=1e-6)
    assert len(got) == 2 and moved < 20_000
    got, moved = most_rows_of_a_stage(spark, extrapolate.percentile_limits(values.selectExpr("k", "if(k = 0, v, null) as v"), "v", ["k"]))
    assert sum(r.median is None for r in got) == 1 and len(got) == 2 and moved < 20_000


@pytest.mark.parametrize("by", [["k"], ["k", "g"], []])
def test_percentile_limits_of_large_groups_are_those_of_a_sort(spark, by):
    rng = np.random.default_rng(5)
    kinds = (rng.normal(size=900), rng.integers(0, 3, 700), np.zeros(400), np.r_[np.zeros(500), rng.normal(size=450)], [1e300, -1e300, 0.5] * 30, [np.nan] * 20 + [2.0] * 300, [7.0], [])
    rows = [(k if k else None, k % 2, float(x)) for k, xs in enumerate(kinds) for x in xs] + [(k, 1, None) for k in (1, 3, 9) for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, g int, v double")
    # 0 sends each group by classes, 90 is the size of one, and None sorts them all
    want, *others = (sorted(map(str, extrapolate.percentile_limits(df, "v", by, 0.9, many).collect())) for many in (None, 0, 89, 90, 100_000))
    assert want and all(got == want for got in others)
