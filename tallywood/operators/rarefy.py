"""Expected distinct keys in a smaller sample, in closed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.functions.special import ln_gamma
from tallywood.operators.histogram import summary


def grid(hist: DataFrame, step: int, by: Sequence[str] = (), end: str = "closed") -> DataFrame:
    """``by, n``: sample sizes step, 2 step, ... up to the total (``closed``) or below it (``open``)."""
    if step < 1:
        raise ValueError("the step must be 1 or more")
    total = F.col("total").cast("long") - (1 if end == "open" else 0)
    sizes = F.when(total >= step, F.sequence(F.lit(step).cast("long"), total, F.lit(step).cast("long")))
    return summary(hist, by).select(*by, F.explode(sizes).alias("n"))


def rarefaction(hist: DataFrame, sizes: DataFrame, by: Sequence[str] = (), compat: str = "reference") -> DataFrame:
    """``by, n, expected_distinct`` for every size ``n`` up to the total of its histogram.

    ``reference`` cuts each bin's unseen keys down to a whole number before they are summed, as the
    published curves do; ``exact`` does not. A histogram is a few hundred rows however large the
    table behind it, so each size meets its bins in a join of small tables.
    """
    if compat not in ("reference", "exact"):
        raise ValueError("compat is 'reference' or 'exact'")
    totals = summary(hist, by).select(*by, F.col("total").alias("_total"), F.col("distinct").alias("_distinct"))
    sizes = sizes.join(totals, list(by)) if by else sizes.crossJoin(totals)  # one row of totals
    # what depends on the size alone is made once for each size, and on the bin once for each bin
    sizes = sizes.where("n <= _total").withColumn("_of_size", ln_gamma(F.col("_total") - F.col("n") + 1) - ln_gamma(F.col("_total") + 1))
    bins = hist.where("n_keys > 0").select(*by, "multiplicity", "n_keys")
    pairs = sizes.join(bins, list(by)) if by else sizes.crossJoin(bins)  # bins by sizes: both bounded by the report
    left = F.col("_total") - F.col("multiplicity")
    ratio = F.exp(ln_gamma(left + 1) - ln_gamma(left - F.col("n") + 1) + F.col("_of_size"))
    unseen = F.when(left >= F.col("n"), ratio * F.col("n_keys")).otherwise(0.0)
    unseen = F.floor(unseen).cast("double") if compat == "reference" else unseen
    return pairs.groupBy(*by, "n").agg((F.max("_distinct") - F.sum(unseen)).alias("expected_distinct"))


def rarefaction_curve(hist: DataFrame, step: int, by: Sequence[str] = (), compat: str = "reference") -> DataFrame:
    return rarefaction(hist, grid(hist, step, by), by, compat)
