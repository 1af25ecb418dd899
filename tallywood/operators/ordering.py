"""Whether rows of a file come in order: each compared with the one before it, across the borders of tasks.

Rows are ordered by ``block`` (columns that name a stretch of a file) and, inside it, ``at``. Blocks
are worked on apart, and only a row for each of them meets the others, so no task sees a whole file.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks and places that :func:`in_file_order` adds.
FILE_BLOCK, FILE_ROW = ("_file", "_begin"), "_row"
RULES = ("start", "pair", "position", "returns", "reach")


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows just read from files, with ``_file, _begin, _row``: a block is what one task reads of a file at once, and rows of it are numbered as read."""
    return rows.withColumns({"_file": F.col("_metadata.file_path"), "_begin": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})


def with_before(rows: DataFrame, block: Sequence[str], at: str, columns: Sequence[str], name: str = "_before") -> DataFrame:
    """``rows`` with a struct of ``columns`` of the row before; null for the first of all."""
    held = F.struct(*columns)
    inside = rows.withColumn(name, F.lag(held).over(Window.partitionBy(*block).orderBy(at)))
    last = rows.groupBy(*block).agg(F.max_by(held, at).alias("_last"))
    # a row for each block: as many as the file has splits
    last = last.select(*block, F.lag("_last").over(Window.partitionBy().orderBy(*block)).alias("_last"))
    return inside.join(last, list(block)).withColumn(name, F.coalesce(name, "_last")).drop("_last")


def _returns(rows: DataFrame, block: Sequence[str], at: str, chrom: str, first_may: bool) -> DataFrame:
    place = F.struct(*block, at)
    new = with_before(rows, block, at, [chrom]).where(F.col("_before").isNull() | ~F.col("_before")[chrom].eqNullSafe(F.col(chrom)))
    new = new.drop("_before").withColumn("_place", place)
    first = new.groupBy(F.col(chrom).alias("_c")).agg(F.min("_place").alias("_first"))
    again = new.join(first, F.col(chrom).eqNullSafe(F.col("_c"))).where(F.col("_place") > F.col("_first"))
    if first_may:
        start = first.agg(F.min_by("_c", "_first").alias("_of"), F.count("*").alias("_n"))
        once = again.join(start, F.col(chrom).eqNullSafe(F.col("_of"))).agg(F.min("_place").alias("_once"))  # one row
        again = again.join(once, F.col("_place") == F.col("_once"), "left_anti")
    return again.drop("_c", "_first", "_place")


def violations(rows: DataFrame, block: Sequence[str], at: str, chrom: str = "chrom", start: str = "start", end: str = "end", rules: Sequence[str] = ("start",), reach: int = 0, first_may_return: bool = False) -> DataFrame:
    """The rows that break ``rules``, with the ``rule``; a row that breaks several comes several times.

    * ``start`` (single ends): it starts before the row before, on one chromosome;
    * ``pair`` (pairs): it starts and ends before the row before, on one chromosome;
    * ``position`` (alignments): its chromosome or, on one chromosome, its start lies before that of the row before;
    * ``returns``: it begins a stretch of a chromosome that the file has left before; ``first_may_return`` lets the
      file's first chromosome come back once, as a check that marks a chromosome on leaving another does;
    * ``reach`` (split intervals in a queue): it starts more than ``reach`` before the furthest start so far of its
      chromosome, so bins that it covers may have been counted already.

    Rows with equal places are compared in any order. Null starts and ends break no rule; a null
    chromosome is one of its own for ``returns`` and equal to none otherwise.
    """
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    out = []
    s, c = F.col(start), F.col(chrom)
    if set(rules) & {"start", "pair", "position"}:
        kept = [chrom, start, *([end] if "pair" in rules else [])]
        compared = with_before(rows, block, at, kept)
        before = lambda k: F.col("_before")[k]
        same = before(chrom) == c
        broken: dict[str, Column] = {"start": same & (s < before(start)), "position": (c < before(chrom)) | (same & (s < before(start)))}
        if "pair" in rules:
            broken["pair"] = same & (s < before(start)) & (F.col(end) < before(end))
        found = F.filter(F.array(*(F.when(broken[r], r) for r in rules if r in broken)), lambda r: r.isNotNull())
        out.append(compared.select(*rows.columns, F.explode(found).alias("rule")))
    if "returns" in rules:
        out.append(_returns(rows, block, at, chrom, first_may_return).select(*rows.columns, F.lit("returns").alias("rule")))
    if "reach" in rules:
        so_far = Window.partitionBy(chrom, *block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        furthest = rows.groupBy(chrom, *block).agg(F.max(start).alias("_m"))
        earlier = Window.partitionBy(chrom).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
        furthest = furthest.select(F.col(chrom).alias("_c"), *(F.col(b).alias(f"_b{k}") for k, b in enumerate(block)), F.max("_m").over(earlier).alias("_m"))
        on = reduce(lambda x, y: x & y, [F.col(b) == F.col(f"_b{k}") for k, b in enumerate(block)], c.eqNullSafe(F.col("_c")))
        behind = rows.withColumn("_own", F.max(start).over(so_far)).join(furthest, on, "left")
        out.append(behind.where(s + reach < F.greatest("_own", "_m")).select(*rows.columns, F.lit("reach").alias("rule")))
    return reduce(DataFrame.unionByName, out)


def checked(rows: DataFrame, *args, **options) -> DataFrame:
    """``rows``, or an error where :func:`violations` finds any; it runs at once."""
    worst = violations(rows, *args, **options).limit(1).collect()
    if worst:
        raise ValueError(f"rows are out of order (rule {worst[0].rule}): {worst[0].asDict()}")
    return rows
