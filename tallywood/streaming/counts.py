"""Histograms of streams: running multiplicities, and windows with bounded lateness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywood.operators.histogram import histogram_of_counts


def running_multiplicities(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, count`` so far; the state is one count for each key. For update and complete mode."""
    return stream.groupBy(*keys).count()


def windowed_histogram(stream: DataFrame, keys: Sequence[str], time: str, window: str, lateness: str) -> DataFrame:
    """``window, keys, count`` once a window is closed; rows later than ``lateness`` drop out. For append mode."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window), *keys).count()


def on_each_histogram(stream: DataFrame, keys: Sequence[str], do: Callable[[DataFrame, int], None], **options) -> StreamingQuery:
    """Calls ``do(histogram, batch)`` with the histogram of all rows so far after each batch."""
    counts = running_multiplicities(stream, keys)
    return counts.writeStream.outputMode("complete").options(**options).foreachBatch(lambda df, n: do(histogram_of_counts(df), n)).start()


def bin_coverage(stream: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Covered bins of a stream of rows with ``bin``; positions need no order, as state holds every bin."""
    return stream.groupBy(chrom, "bin").count()
