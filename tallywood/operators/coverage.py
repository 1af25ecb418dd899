"""Coverage: intervals split into fixed bins, and how often each bin is covered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywood.functions.special import hash_uniform
from tallywood.operators.histogram import histogram


def _limit(intervals: DataFrame, start: str, end: str, max_width: int | None) -> DataFrame:
    if max_width is None:
        return intervals
    width = F.col(end) - F.col(start)
    return intervals.withColumn(end, F.when(width > max_width, F.raise_error(F.concat(F.lit("interval wider than the limit: "), width.cast("string")))).otherwise(F.col(end)))


def floor_bins(intervals: DataFrame, bin_size: int, start: str = "start", end: str = "end", max_width: int | None = None) -> DataFrame:
    """``intervals`` exploded to ``bin``: bins floor(start / b) to floor(end / b) - 1; an interval inside one bin has none."""
    lo, hi = F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size) - 1
    return _limit(intervals, start, end, max_width).withColumn("bin", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))


def hashed_bins(intervals: DataFrame, bin_size: int, key: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """``intervals`` exploded to ``bin`` with chance in proportion to the overlap.

    The start moves to a bin edge, up with the chance of its part of a bin, and the width stays; a
    bin is then kept with the chance of its covered part. Chances come from hashes of ``key`` (and
    the bin), so the same rows give the same bins however they are dealt to tasks.
    """
    b = F.lit(bin_size)
    keys = [F.col(k) for k in key]
    over = F.pmod(F.col(start), b) / b
    moved = F.floor(F.col(start) / b) * b + F.when(hash_uniform(*keys, F.lit("start")) > over, 0).otherwise(F.when(over > 0, b).otherwise(0))
    rows = intervals.withColumn("_s", moved).withColumn("_e", moved + F.col(end) - F.col(start))
    rows = rows.withColumn("bin", F.explode(F.when(F.col("_e") > F.col("_s"), F.sequence(F.floor(F.col("_s") / b), F.ceil(F.col("_e") / b) - 1))))
    part = (F.least(F.col("_e"), (F.col("bin") + 1) * b) - F.greatest(F.col("_s"), F.col("bin") * b)) / b
    return rows.where(hash_uniform(*keys, F.col("bin")) <= part).drop("_s", "_e")


def base_bins(reads: DataFrame, bin_size: int, key: Sequence[str], start: str = "start", seq: str = "seq", end: str = "end", max_width: int | None = None) -> DataFrame:
    """``reads`` exploded to ``bin`` with chance in proportion to the bases of the bin that are known (not N).

    A read that is wider, from ``start`` to ``end``, than ``max_width`` is an error.
    """
    b = F.lit(bin_size)
    if max_width is not None:
        reads = _limit(reads, start, end, max_width).where(F.col(end).isNotNull())  # the filter has every width looked at
    first, last = F.floor(F.col(start) / b), F.floor((F.col(start) + F.length(seq) - 1) / b)
    rows = reads.withColumn("bin", F.explode(F.when(F.length(seq) > 0, F.sequence(first, last))))
    lo = F.greatest(F.col("bin") * b - F.col(start), F.lit(0))
    hi = F.least((F.col("bin") + 1) * b - F.col(start), F.length(seq))
    covered = known_bases(F.substring(F.col(seq), (lo + 1).cast("int"), (hi - lo).cast("int"))) / b
    return rows.where((covered > 0) & (hash_uniform(*(F.col(k) for k in key), F.col("bin")) <= covered))


def known_bases(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "N", ""))


def coverage_histogram(bins: DataFrame, chrom: str = "chrom", by: Sequence[str] = (), compat: str = "exact", origin: tuple | None = None) -> DataFrame:
    """How many bins are covered so many times.

    ``compat="reference"`` gives what a count of runs over sorted bins gives that never closes its
    last run and closes one before its first bin: the last bin, by chromosome and place, is missing,
    and a bin covered once is added, unless the first bin is ``origin`` (chromosome and bin), with
    which such a count begins. Both are read off the histogram itself, which keeps the first and the
    last place of each multiplicity.
    """
    if compat not in ("exact", "reference"):
        raise ValueError(f"unknown compat: {compat}")
    if compat == "exact":
        return histogram(bins, [chrom, "bin"], by)
    place = F.struct(F.col(chrom).alias("chrom"), F.col("bin").alias("bin"))
    covered = bins.groupBy(*by, chrom, "bin").agg(F.count("*").alias("multiplicity"))
    hist = covered.groupBy(*by, "multiplicity").agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    ends = hist.groupBy(*by).agg(F.max_by("multiplicity", "hi").alias("lost"), F.min("lo").alias("lo"))
    first = F.lit(1) if origin is None else F.when((F.col("lo.chrom") == origin[0]) & (F.col("lo.bin") == origin[1]), 0).otherwise(1)
    lost = ends.select(*by, F.col("lost").alias("multiplicity"), F.lit(-1).alias("n"))
    added = ends.where("lost is not null").select(*by, F.lit(1).cast("long").alias("multiplicity"), first.alias("n"))
    # few rows: those of the histogram and two for each of ``by``
    both = hist.select(*by, "multiplicity", F.col("n").cast("long").alias("n")).union(lost.where("multiplicity is not null")).union(added)
    return both.groupBy(*by, "multiplicity").agg(F.sum("n").cast("double").alias("n_keys")).where("n_keys > 0")


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR string consumes."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def order_violations(rows: DataFrame, order: str, chrom: str = "chrom", start: str = "start", end: str | None = None) -> DataFrame:
    """Rows whose start (or, with ``end``, both start and end) lies before that of the row before of its chromosome."""
    from pyspark.sql import Window

    before = Window.partitionBy(chrom).orderBy(order)
    back = F.col(start) < F.lag(start).over(before)
    if end is not None:
        back = back & (F.col(end) < F.lag(end).over(before))
    return rows.withColumn("_back", back).where("_back").drop("_back")


def deduplicated(rows: DataFrame, paired: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The duplicate-count histogram of intervals: by (chrom, start), or (chrom, start, end) for pairs."""
    return histogram(rows, ["chrom", "start", "end"] if paired else ["chrom", "start"], by)


def aligned(rows: DataFrame) -> DataFrame:
    """Alignments that have a place."""
    return rows.where("tid <> -1")
