"""Multiplicities of keys, their frequency-of-frequencies histogram, and what is read off it.

A histogram has ``multiplicity`` (long), ``n_keys`` (double) and the columns of ``by``, one histogram
for each of their values. Both aggregations combine on the map side, so a hot key is one row after
the first; everything after the second works on a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiplicities(observations: DataFrame, keys: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """How often each key was seen: ``by``, ``multiplicity``."""
    own = observations.select(*by, *(F.col(k).alias(f"_k{i}") if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(keys)))
    return own.groupBy(*by, *(f"_k{i}" for i in range(len(keys)))).agg(F.count("*").alias("multiplicity")).select(*by, "multiplicity")


def histogram(observations: DataFrame, keys: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """The histogram of a table of observations: one row per observation, any key columns."""
    return histogram_of_counts(multiplicities(observations, keys, by), "multiplicity", by)


def histogram_of_counts(counts: DataFrame, count: str = "count", by: Sequence[str] = ()) -> DataFrame:
    """The histogram of counts that are known already. Fractions are cut off; counts under 1 drop out; negative ones are errors."""
    value = F.col(count).cast("double")
    checked = F.when(value < 0, F.raise_error(F.concat(F.lit("negative count "), value.cast("string")))).otherwise(value)
    rows = counts.select(*by, checked.cast("long").alias("multiplicity")).where("multiplicity >= 1")
    return rows.groupBy(*by, "multiplicity").agg(F.count("*").cast("double").alias("n_keys"))


def positive_bins(hist: DataFrame) -> DataFrame:
    return hist.where("n_keys > 0")


def summary(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``total, distinct, n_counts, max_count, singletons``."""
    j, h = F.col("multiplicity"), F.col("n_keys")
    return hist.groupBy(*by).agg(
        F.coalesce(F.sum(j * h), F.lit(0.0)).alias("total"), F.coalesce(F.sum(h), F.lit(0.0)).alias("distinct"), F.count_if(h > 0).alias("n_counts"),
        F.max(F.when(h > 0, j)).alias("max_count"), F.coalesce(F.sum(F.when(j == 1, h)), F.lit(0.0)).alias("singletons"),
    )


def good_toulmin(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``two_fold``: new keys expected when the sample doubles; below 0 where it is saturated."""
    sign = F.when(F.col("multiplicity") % 2 == 1, 1.0).otherwise(-1.0)
    return hist.groupBy(*by).agg(F.coalesce(F.sum(sign * F.col("n_keys")), F.lit(0.0)).alias("two_fold"))


def usable_terms(hist: DataFrame, max_terms: int = 100, by: Sequence[str] = (), even: bool = True) -> DataFrame:
    """``first_zero, terms``: the first empty bin, and how many leading bins a power series may use."""
    order = Window.partitionBy(*by).orderBy("multiplicity")
    run = hist.where("n_keys > 0 and multiplicity >= 1").withColumn("_n", F.row_number().over(order))
    out = run.groupBy(*by).agg((F.count_if(F.col("_n") == F.col("multiplicity")) + 1).alias("first_zero"))
    terms = F.least(F.lit(max_terms).cast("long"), F.col("first_zero") - 1)
    return out.withColumn("terms", terms - terms % 2 if even else terms)


def _leading(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bins with keys, with ``_leading``: how many bins from 1 on are there without a gap. One pass."""
    run = hist.where("n_keys > 0 and multiplicity >= 1").withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("multiplicity")))
    return run.withColumn("_leading", F.count_if(F.col("_n") == F.col("multiplicity")).over(Window.partitionBy(*by)))


_SIGN = "case when multiplicity % 2 = 1 then 1D else -1D end"


def gate(hist: DataFrame, max_terms: int = 100, least_terms: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """``status``: ``saturated``, ``too_shallow`` or ``ok``, with what it was judged by."""
    leading, two_fold = F.coalesce(F.max("_leading"), F.lit(0)), F.coalesce(F.sum(F.expr(_SIGN) * F.col("n_keys")), F.lit(0.0))
    rows = _leading(hist, by).groupBy(*by).agg((leading + 1).alias("first_zero"), two_fold.alias("two_fold"))
    terms = F.least(F.lit(max_terms).cast("long"), F.col("first_zero") - 1)
    status = F.when(F.col("two_fold") < 0, "saturated").when(F.col("terms") < least_terms, "too_shallow").otherwise("ok")
    return rows.withColumn("terms", terms - terms % 2).select(*by, "first_zero", "terms", "two_fold", status.alias("status"))


def power_series(hist: DataFrame, max_terms: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """``term, coefficient``: the alternating series of new keys per unit of fold change, term from 0."""
    most = F.least(F.lit(max_terms).cast("long"), F.col("_leading"))
    rows = _leading(hist, by).where(F.col("multiplicity") <= most - most % 2)
    return rows.select(*by, (F.col("multiplicity") - 1).alias("term"), (F.expr(_SIGN) * F.col("n_keys")).alias("coefficient"))


def factorial_moments(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``r, moment, ln_moment``: (r + 1)! h[r + 1] / h[1] from r = 0, up to the first empty bin; the moment is infinite where it passes a double."""
    from tallywood.functions.special import ln_gamma

    first = F.max(F.when(F.col("multiplicity") == 1, F.col("n_keys"))).over(Window.partitionBy(*by))
    rows = _leading(hist, by).withColumn("_h1", first).where("multiplicity <= _leading")
    moment = ln_gamma(F.col("multiplicity") + 1) + F.log("n_keys") - F.log("_h1")
    return rows.select(*by, (F.col("multiplicity") - 1).alias("r"), F.exp(moment).alias("moment"), moment.alias("ln_moment"))


def chao1(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``chao1``: S + h1 (h1 - 1) / (2 (h2 + 1)), a bound for samples that are too saturated to extrapolate."""
    h = lambda k: F.coalesce(F.sum(F.when(F.col("multiplicity") == k, F.col("n_keys"))), F.lit(0.0))
    return hist.groupBy(*by).agg((F.sum("n_keys") + h(1) * (h(1) - 1) / (2 * (h(2) + 1))).alias("chao1"))


def zelterman(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``zelterman``: S / (1 - exp(-2 h2 / h1)); null without both bins."""
    h = lambda k: F.sum(F.when(F.col("multiplicity") == k, F.col("n_keys")))
    return hist.groupBy(*by).agg((F.sum("n_keys") / (1 - F.exp(-2 * h(2) / h(1)))).alias("zelterman"))
