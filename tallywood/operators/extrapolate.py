"""Yield curves beyond the sample: quick estimates for many histograms, bootstrap with confidence limits for one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywood.functions.storage import shared_folder
from tallywood.operators import contfrac, moments

#: Rows of a histogram that may travel to every task; distinct multiplicities grow with the square root of the table.
MOST_BINS = 2_000_000
#: Rows up to which a group is sorted whole for its quantiles, and the share of a larger one's rows sorted on each side of a quantile.
MANY, NEAR = 100_000, 0.001


def _sizes(step: float, most: float, total: float | None = None) -> np.ndarray:
    """step, 2 step, ... below ``most``."""
    if step < 1:
        raise ValueError("the step must be 1 or more")
    return np.arange(1, int(np.ceil(most / step))) * float(step)


def _rows(pdf: pd.DataFrame, by: Sequence[str], **columns) -> pd.DataFrame:
    out = pd.DataFrame(columns)
    for k in reversed(by):
        out.insert(0, k, [pdf[k].iloc[0]] * len(out))
    return out


def _fields(hist: DataFrame, by: Sequence[str]) -> str:
    kinds = dict(hist.dtypes)
    return "".join(f"{k} {kinds[k]}, " for k in by)


def _grouped(hist: DataFrame, by: Sequence[str]):
    """One group for each histogram; its rows are few whatever the table behind it."""
    return hist.select(*by, "multiplicity", "n_keys").groupBy(*by) if by else hist.select("multiplicity", "n_keys").groupBy()


def quick_curve(hist: DataFrame, step: float = 1e6, most: float = 1e10, max_terms: int = 100, by: Sequence[str] = (), defects: bool = False, compat: str = "reference", in_totals: bool = False) -> DataFrame:
    """``by, x, expected_distinct, status``: the curve of each histogram without resampling.

    ``status`` is ``ok``; a histogram that is ``saturated``, ``too_shallow`` or ``unstable`` gives
    one row of it without a curve. With ``in_totals``, ``step`` and ``most`` are multiples of each
    histogram's own total.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h = contfrac.Histogram.of(pdf["multiplicity"], pdf["n_keys"])
        status = _judged(h, max_terms)
        unit = h.total if in_totals else 1.0
        x = _sizes(step * unit, most * unit) if status == "ok" else None
        y = contfrac.curve(h, x, max_terms, defects=defects, compat=compat) if status == "ok" else None
        if y is None:
            return _rows(pdf, by, x=[np.nan], expected_distinct=[np.nan], status=["unstable" if status == "ok" else status])
        return _rows(pdf, by, x=x, expected_distinct=y, status=["ok"] * len(x))

    return _grouped(hist, by).applyInPandas(one, f"{_fields(hist, by)}x double, expected_distinct double, status string")


def _judged(hist: contfrac.Histogram, max_terms: int) -> str:
    sign = np.where(hist.j % 2 == 1, 1.0, -1.0)
    return "saturated" if sign @ hist.h < 0 else "too_shallow" if contfrac.terms_of(hist.head(max_terms + 1), max_terms) < 4 else "ok"


def fraction_of(hist: DataFrame, max_terms: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """``by, degree, ps, cf``: the stable fraction of each histogram; degree 0 where there is none."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h = contfrac.Histogram.of(pdf["multiplicity"], pdf["n_keys"]).head(max_terms + 1)
        terms = contfrac.terms_of(h, max_terms)
        f = contfrac.optimal(h, terms)
        series = np.where(np.arange(terms) % 2 == 0, 1.0, -1.0) * h[1 : terms + 1]
        return _rows(pdf, by, degree=[0 if f is None else f.degree], ps=[series], cf=[[] if f is None else f.fraction])

    return _grouped(hist, by).applyInPandas(one, f"{_fields(hist, by)}degree int, ps array<double>, cf array<double>")


def quick_bound(hist: DataFrame, most_points: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """``by, estimate, n_points``: the quadrature bound on the classes of each histogram."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h = contfrac.Histogram.of(pdf["multiplicity"], pdf["n_keys"])
        value, points = moments.richness(h.head(2 * most_points + 1), most_points, distinct=h.distinct)
        return _rows(pdf, by, estimate=[value], n_points=[points])

    return _grouped(hist, by).applyInPandas(one, f"{_fields(hist, by)}estimate double, n_points int")


def diagnostics(hist: DataFrame, max_terms: int = 100, most_points: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """What the estimates of each histogram rest on: ``by, kind, nr, value``, a row for each number.

    ``total``, ``distinct``, ``max_count``, ``n_counts``, ``singletons``, ``two_fold`` and ``terms``
    (``nr`` 0); of the fraction ``series``, ``coefficient`` and ``degree`` (none where no fraction is
    stable); of the bound ``moment``, ``alpha``, ``beta``, ``point``, ``weight``, ``n_points`` and
    ``unseen``, numbered from 0.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h = contfrac.Histogram.of(pdf["multiplicity"], pdf["n_keys"])
        found = _facts(h, max_terms, most_points)
        rows = [(kind, at, float(x)) for kind, values in found.items() for at, x in enumerate(np.atleast_1d(values))]
        return _rows(pdf, by, kind=[r[0] for r in rows], nr=[r[1] for r in rows], value=[r[2] for r in rows])

    return _grouped(hist, by).applyInPandas(one, f"{_fields(hist, by)}kind string, nr int, value double")


def bootstrap_diagnostics(hist: DataFrame, replicates: int = 100, max_terms: int = 100, most_points: int = 10, seed: int = 408) -> DataFrame:
    """:func:`diagnostics` of the first ``replicates`` redraws: ``attempt, kind, nr, value``."""
    spark = hist.sparkSession
    j, h = _small(hist)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for attempt in pdf["id"]:
                found = _facts(resample(j, h, seed, int(attempt)), max_terms, most_points)
                rows = [(int(attempt), kind, at, float(x)) for kind, values in found.items() for at, x in enumerate(np.atleast_1d(values))]
                yield pd.DataFrame(rows, columns=["attempt", "kind", "nr", "value"])

    return spark.range(0, replicates, numPartitions=min(replicates, spark.sparkContext.defaultParallelism)).mapInPandas(run, "attempt long, kind string, nr int, value double")


def _facts(h: contfrac.Histogram, max_terms: int, most_points: int) -> dict:
    head = h.head(max(max_terms, 2 * most_points) + 1)
    terms = contfrac.terms_of(head[: max_terms + 2], max_terms)
    single = float(head[1]) if len(head) > 1 else 0.0
    found = {"total": h.total, "distinct": h.distinct, "max_count": h.j.max(initial=0), "n_counts": len(h.j), "singletons": single, "two_fold": float(np.where(h.j % 2 == 1, 1.0, -1.0) @ h.h), "terms": terms}
    best = contfrac.optimal(head[: max_terms + 2], terms) if terms >= 4 else None
    if best is not None:
        found |= {"series": np.where(np.arange(terms) % 2 == 0, 1.0, -1.0) * head[1 : terms + 1], "coefficient": best.fraction, "degree": best.degree}
    mu = moments.moments_of(head, 2 * most_points) if single > 0 else np.empty(0)
    found["moment"] = mu
    if len(mu) >= 2:
        n = moments.definite(mu, most_points)
        alpha, beta = moments.recurrence(mu, n)
        points, weights = moments.rule(mu, n)
        found |= {"alpha": alpha, "beta": beta, "point": points, "weight": weights, "n_points": len(points), "unseen": float((single * weights / points).sum()) if len(points) else 0.0}
    return found


def _small(hist: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = hist.where("n_keys > 0").select("multiplicity", "n_keys").limit(MOST_BINS + 1).toPandas().sort_values("multiplicity")
    if len(rows) > MOST_BINS:
        raise ValueError(f"the histogram has over {MOST_BINS} bins")
    return rows["multiplicity"].to_numpy(), rows["n_keys"].to_numpy()


def local(hist: DataFrame) -> DataFrame:
    """The histogram as rows of the plan itself, so that what uses it several times computes it once; MOST_BINS rows at most."""
    j, h = _small(hist)
    return hist.sparkSession.createDataFrame(pd.DataFrame({"multiplicity": j.astype(np.int64), "n_keys": h.astype(float)}), "multiplicity long, n_keys double")


def resample(j: np.ndarray, h: np.ndarray, seed: int, attempt: int) -> contfrac.Histogram:
    """A multinomial redraw of a histogram; it depends on the seed and the attempt alone."""
    return contfrac.Histogram.of(j, np.random.default_rng([seed, attempt]).multinomial(int(h.sum()), h / h.sum()))


def bootstrap_curves(hist: DataFrame, step: float, most: float, replicates: int = 100, max_terms: int = 100, seed: int = 408, budget: int = 100, defects: bool = False, compat: str = "reference") -> DataFrame:
    """``attempt, curve``: the first ``replicates`` redraws with a stable curve, of ``budget`` times as many at most.

    Attempts run in parallel, in waves; which of them succeed does not depend on how they are dealt
    to tasks. Too few successes are an error.
    """
    spark = hist.sparkSession
    j, h = _small(hist)
    x, distinct = _sizes(step, most), float(h.sum())
    status = _judged(contfrac.Histogram.of(j, h), max_terms)
    if status != "ok":
        raise ValueError(f"the sample is {status.replace('_', ' ')} for extrapolation")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for attempt in pdf["id"]:
                y = contfrac.curve(resample(j, h, seed, int(attempt)), x, max_terms, distinct, defects, compat)
                if y is not None and (defects or contfrac.stable(y)):
                    yield pd.DataFrame({"attempt": [attempt], "curve": [y]})

    shared_folder(spark)  # for the waves, each of which is run once
    done, waves, tasks = 0, [], max(1, spark.sparkContext.defaultParallelism)
    while done < budget * replicates:
        wave = min(2 * replicates, budget * replicates - done)
        waves.append(spark.range(done, done + wave, numPartitions=min(tasks, wave)).mapInPandas(run, "attempt long, curve array<double>").checkpoint())
        done += wave
        found = reduce(DataFrame.union, waves)
        if found.count() >= replicates:
            return found.orderBy("attempt").limit(replicates)
    raise ValueError("too few resampled curves were stable")


def percentile_limits(replicates: DataFrame, value: str, by: Sequence[str] = (), level: float = 0.95, many: int | None = MANY) -> DataFrame:
    """``by, median, lower, upper``: exact quantiles, interpolated between ranks; nulls have no rank, and a group of nulls alone has null limits.

    A group of up to ``many`` rows is sorted. In a larger one, approximate quantiles on both sides of
    each wanted one part the values into classes; rows are counted by class, and only the classes
    that hold a wanted rank, some thousandths of the rows, are counted by value and sorted. The ranks are
    exact however good the approximation is. ``replicates`` is read several times, unless ``many`` is None, for
    groups that are known to be small.
    """
    shares = {"median": 0.5, "lower": (1 - level) / 2, "upper": (1 + level) / 2}
    rows = replicates.select(*by, F.col(value).cast("double").alias("_v"))
    if many is None:
        return _limits_at(_by_sort(rows, by), by, shares)
    near = sorted({min(max(q + d, 0.0), 1.0) for q in shares.values() for d in (-NEAR, NEAR)})
    large = rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", near, round(10 / NEAR)).alias("_s")).where(F.col("_n") > many)
    large = F.broadcast(large.select(*(F.col(k).alias(f"_of_{k}") for k in by), "_n", *(F.col("_s")[i].alias(f"_s{i}") for i in range(len(near)))))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by), F.lit(True))
    valued = rows.where("_v is not null")
    nulls = rows.where("_v is null").groupBy(*by).agg(F.max("_v").alias("_v")).withColumns({c: F.lit(None).cast("long") for c in ("_n", "_first", "_last")})
    ranked = [_by_sort(valued.join(large, same, "left_anti"), by), _by_classes(valued.join(large, same), by, shares, len(near)), nulls]
    return _limits_at(reduce(DataFrame.unionByName, ranked), by, shares)


def _by_sort(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, _v, _n, _first, _last``: each value with the rows of its group and the ranks, from 0, that it takes there."""
    group = Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(F.asc_nulls_last("_v"))) - 1
    return rows.withColumn("_n", F.count("_v").over(group)).withColumn("_first", rank.cast("long")).withColumn("_last", F.col("_first"))


def _by_classes(rows: DataFrame, by: Sequence[str], shares: dict[str, float], cuts: int) -> DataFrame:
    """:func:`_by_sort` of ``by, _v, _n, _s0, _s1, ...`` in which only values near the wanted ranks appear; each cut is a class of its own."""
    own = [F.col(f"_s{i}") for i in range(cuts)]
    rows = rows.select(*by, "_v", "_n", sum(((F.col("_v") > s).cast("int") + (F.col("_v") >= s).cast("int") for s in own), F.lit(0)).alias("_c"))
    upto = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_c"))
    classes = rows.groupBy(*by, "_n", "_c").agg(F.count("*").alias("_rows")).withColumn("_before", upto - F.col("_rows"))
    ranks = [f(at) for q in shares.values() for at in ((F.col("_n") - 1) * q,) for f in (F.floor, F.ceil)]
    held = reduce(Column.__or__, ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_rows")) for r in ranks))
    held = classes.where(held).select(*(F.col(k).alias(f"_of_{k}") for k in by), F.col("_c").alias("_of_c"), "_before")
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by), F.col("_c") == F.col("_of_c"))
    values = rows.join(F.broadcast(held), same).groupBy(*by, "_n", "_c", "_before", "_v").agg(F.count("*").alias("_rows"))
    last = F.col("_before") + F.sum("_rows").over(Window.partitionBy(*by, "_c").orderBy("_v")) - 1
    return values.withColumn("_last", last).select(*by, "_v", "_n", (F.col("_last") - F.col("_rows") + 1).alias("_first"), "_last")


def _limits_at(ranked: DataFrame, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    ends = []
    for name, q in shares.items():
        at = (F.col("_n") - 1) * q
        low, high = (F.max(F.when(f(at).between(F.col("_first"), F.col("_last")), F.col("_v"))) for f in (F.floor, F.ceil))
        ends += [low.alias(f"_lo_{name}"), high.alias(f"_hi_{name}"), F.max(at - F.floor(at)).alias(f"_part_{name}")]
    found = ranked.groupBy(*by).agg(*ends)
    return found.select(*by, *((F.col(f"_lo_{n}") * (1 - F.col(f"_part_{n}")) + F.col(f"_hi_{n}") * F.col(f"_part_{n}")).alias(n) for n in shares))


def lc_extrap(hist: DataFrame, step: float = 1e6, most: float = 1e10, level: float = 0.95, **options) -> DataFrame:
    """``x, median, lower, upper``: the yield curve with bootstrap limits; see :func:`bootstrap_curves`."""
    curves = bootstrap_curves(hist, step, most, **options)
    points = curves.select(F.posexplode("curve").alias("at", "y"))
    return percentile_limits(points, "y", ["at"], level, many=None).select(((F.col("at") + 1) * step).alias("x"), "median", "lower", "upper")


def gc_extrap(hist: DataFrame, bin_size: int = 10, step: float = 1e8, most: float = 1e12, budget: int = 10, **options) -> DataFrame:
    """:func:`lc_extrap` of a histogram of covered bins, in bases."""
    out = lc_extrap(hist, step / bin_size, most / bin_size, budget=budget, **options)
    return out.select(*((F.col(c) * bin_size).alias(c) for c in out.columns))


def horizon(hist: DataFrame, steps: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """``most, step``: how far a population estimate extrapolates, 1e9 times the distinct keys."""
    return hist.groupBy(*by).agg(F.sum("n_keys").alias("_s")).select(*by, (F.col("_s") * 1e9).alias("most"), ((F.col("_s") * 1e9 - F.col("_s")) / steps).alias("step"))


def with_increments(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``curve(x, y)`` with ``increment``, the growth since the point before."""
    return curve.withColumn("increment", F.col("y") - F.lag("y").over(Window.partitionBy(*by).orderBy("x")))


def converged(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``last, converged``: the last value, and whether the last of at least three points grew by less than 1."""
    last = F.max_by(F.struct("y", "increment"), "x").alias("_l")
    rows = with_increments(curve, by).groupBy(*by).agg(last, F.count("*").alias("_n"))
    return rows.select(*by, F.col("_l.y").alias("last"), F.coalesce((F.col("_n") >= 3) & (F.col("_l.increment") < 1), F.lit(False)).alias("converged"))


def pop_size(hist: DataFrame, most: float = 0, steps: int = 50, level: float = 0.95, **options) -> DataFrame:
    """One row ``pop_size_estimate, lower, upper, converged``: the end of a very long curve."""
    hist = local(hist)
    h = horizon(hist, steps).first()
    end, step = (h.most, h.step) if not most else (most, (most - h.most / 1e9) / steps)
    curve = with_increments(lc_extrap(hist, step, end, level, **options).withColumn("y", F.col("median")))
    last = curve.agg(F.max_by(F.struct("median", "lower", "upper", "increment"), "x").alias("_l"), F.count("*").alias("_n"))
    flag = F.coalesce((F.col("_n") >= 3) & (F.col("_l.increment") < 1), F.lit(False))
    return last.select(F.col("_l.median").alias("pop_size_estimate"), "_l.lower", "_l.upper", flag.alias("converged"))


def bound_pop(hist: DataFrame, replicates: int = 500, most_points: int = 10, max_replicates: int = 100, level: float = 0.95, seed: int = 408) -> DataFrame:
    """One row ``median, lower, upper``: the quadrature bound over redraws; singletons are those of the sample itself."""
    spark = hist.sparkSession
    j, h = _small(hist)
    first, many = float(h[j == 1].sum()), min(replicates, max_replicates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = [resample(j, h, seed, int(a)) for a in pdf["id"]]
            yield pd.DataFrame({"attempt": pdf["id"], "estimate": [moments.richness(d.head(2 * most_points + 1), most_points, first, d.distinct)[0] for d in drawn]})

    values = spark.range(0, many, numPartitions=min(many, spark.sparkContext.defaultParallelism)).mapInPandas(run, "attempt long, estimate double")
    return percentile_limits(values, "estimate", (), level, many=None)
