"""Results as tab-separated text: the lines of a small result, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def general(value: Column) -> Column:
    """A number in six significant digits, in scientific form from a million on (as C's %g)."""
    digits = F.when(value == 0, 1).otherwise(F.floor(F.log10(F.abs(F.nullif(value, F.lit(0.0))))) + 1)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.bround(value, 6)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = F.format_string("%.0f", value)
    fine = F.element_at(F.array(*(F.regexp_replace(F.regexp_replace(F.format_string(f"%.{6 - k}f", value), r"(\.\d*?)0+$", "$1"), r"\.$", "") for k in range(1, 7))), F.greatest(F.least(digits, F.lit(6)), F.lit(1)).cast("int"))
    mantissa = F.regexp_replace(F.format_string("%.5e", value), r"\.?0*e", "e")
    return F.when(F.abs(value) >= 999999.5, mantissa).when(F.abs(value) < 1, plain).when(digits == 6, whole).otherwise(fine)


def fixed(value: Column) -> Column:
    return F.format_string("%.1f", value)


def _lines(rows: DataFrame, order: str, header: list[str], columns: list[Column], zero: list[str] | None = None) -> list[str]:
    """A report is as long as its grid; that is what comes to the driver."""
    body = [r.line for r in rows.orderBy(order).select(F.concat_ws("\t", *columns).alias("line")).collect()]
    return ["\t".join(header), *(["\t".join(zero)] if zero else []), *body]


def histogram(hist: DataFrame) -> list[str]:
    rows = hist.where("n_keys > 0").orderBy("multiplicity")
    return [r.line for r in rows.select(F.concat_ws("\t", F.col("multiplicity").cast("string"), F.col("n_keys").cast("long").cast("string")).alias("line")).collect()]


def rarefaction(curve: DataFrame) -> list[str]:
    return _lines(curve, "n", ["total_reads", "distinct_reads"], [F.col("n").cast("string"), general(F.col("expected_distinct"))], ["0", "0"])


def yield_curve(curve: DataFrame, level: float | None = 0.95, unit: str = "READS") -> list[str]:
    """With limits (``median, lower, upper``), or without where ``level`` is none (``expected_distinct``)."""
    if level is None:
        return _lines(curve, "x", [f"TOTAL_{unit}", "EXPECTED_DISTINCT"], [fixed(F.col(c)) for c in ("x", "expected_distinct")], ["0", "0"])
    name = f"{level:g}CI" if unit == "READS" else f"{level * 100:g}%CI"
    what = "EXPECTED_DISTINCT" if unit == "READS" else "EXPECTED_COVERED_BASES"
    return _lines(curve, "x", [f"TOTAL_{unit}", what, f"LOWER_{name}", f"UPPER_{name}"], [fixed(F.col(c)) for c in ("x", "median", "lower", "upper")], ["0"] * 4)


def bound(row: DataFrame) -> list[str]:
    if "n_points" in row.columns:
        return _lines(row, "estimate", ["quadrature_estimated_unobs", "n_points"], [fixed(F.col("estimate")), F.col("n_points").cast("string")])
    return _lines(row, "median", ["median_estimated_unobs", "lower_ci", "upper_ci"], [fixed(F.col(c)) for c in ("median", "lower", "upper")])


def population(row: DataFrame) -> list[str]:
    flag = F.when(~F.col("converged"), "not_converged")
    return _lines(row, "pop_size_estimate", ["pop_size_estimate", "lower_ci", "upper_ci"], [*(fixed(F.col(c)) for c in ("pop_size_estimate", "lower", "upper")), flag])
