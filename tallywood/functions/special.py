"""Numeric expressions: log-gamma and what is made of it, as Catalyst expressions and as SQL text."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Lanczos approximation of the gamma function, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)


def ln_gamma_sql(x: str) -> str:
    """SQL text, for Spark and DuckDB alike, of the log of gamma of the text ``x`` (positive)."""
    series = " + ".join([f"{LANCZOS[0]!r}D", *(f"{c!r}D / ({x} + {i - 1}.0D)" for i, c in enumerate(LANCZOS) if i)])
    text = f"({HALF_LOG_TAU!r}D + ({x} - 0.5D) * ln({x} + 6.5D) - ({x} + 6.5D) + ln({series}))"
    return text


def duck(sql: str) -> str:
    """SQL with Spark's double literals, as DuckDB writes them."""
    import re

    return re.sub(r"(?<![\w.])(-?\d+\.?\d*(?:e-?\d+)?)D\b", r"cast(\1 as double)", sql)


def ln_gamma(x: Column | str) -> Column:
    """The log of gamma of a positive column; stays in generated code."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS):
        if i:
            series = series + F.lit(c) / (x + (i - 1.0))
    return F.lit(HALF_LOG_TAU) + (x - 0.5) * F.log(x + 6.5) - (x + 6.5) + F.log(series)


def ln_gamma_np(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    series = LANCZOS[0] + sum(c / (x + (i - 1)) for i, c in enumerate(LANCZOS) if i)
    return HALF_LOG_TAU + (x - 0.5) * np.log(x + 6.5) - (x + 6.5) + np.log(series)


def ln_factorial(x: Column | str) -> Column:
    return ln_gamma((F.col(x) if isinstance(x, str) else x) + 1)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1)


def fold_change(x: Column, total: Column) -> Column:
    """How many times the sample is grown beyond itself: (x - N) / N."""
    return (x - total) / total


def hash_uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone: the first 32 bits of their md5."""
    text = F.concat_ws("|", *(c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def register_functions(spark: SparkSession) -> None:
    """``ln_gamma`` and ``choose_ratio`` as temporary SQL functions."""
    spark.sql(f"create or replace temporary function ln_gamma(x double) returns double return {ln_gamma_sql('x')}")
    spark.sql("create or replace temporary function choose_ratio(total double, i double, n double) returns double return if(total < i + n, 0D, exp(ln_gamma(total - i + 1) - ln_gamma(total - i - n + 1) - ln_gamma(total + 1) + ln_gamma(total - n + 1)))")
