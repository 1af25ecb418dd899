"""Readers of the text formats: histograms, counts, intervals and reads. Bad lines are errors, not nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.operators.histogram import histogram_of_counts
from tallywood.operators.ordering import in_file_order

BED = "chrom string, start long, end long, name string, score double, strand string"
MAPPED_READS = BED + ", seq string"
_NUMBER = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def _error(when: Column, what: str, line: Column, value: Column) -> Column:
    return F.when(when, F.raise_error(F.concat(F.lit(what + ": "), line))).otherwise(value)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """``multiplicity, n_keys`` from lines of two numbers.

    Errors: a carriage return, a line that isn't two numbers, a multiplicity below 1, out of order or
    given twice. The file is a histogram, so it is small; its order is checked by the place of lines.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
    found = F.col("line")
    j, h = F.try_to_number(F.regexp_extract(found, r"^\s*(\d+)\s+\S", 1), F.lit("9999999999999999999")), F.regexp_extract(found, r"^\s*\d+\s+([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$", 1)
    rows = text.withColumn("multiplicity", j.cast("long")).withColumn("n_keys", F.when(h != "", h).cast("double"))
    before = F.lag("multiplicity").over(Window.partitionBy().orderBy("at"))
    checked = _error(found.contains("\r"), "carriage return", found, F.col("multiplicity"))
    checked = _error(F.col("multiplicity").isNull() | F.col("n_keys").isNull(), "not a line of a histogram", found, checked)
    checked = _error(F.col("multiplicity") < 1, "multiplicity below 1", found, checked)
    checked = _error(F.col("multiplicity") <= F.col("_before"), "multiplicity out of order", found, checked)
    return rows.withColumn("_before", before).select(checked.alias("multiplicity"), "n_keys")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The histogram of a file of one count a line.

    Blank lines, zeros and lines that start with no number are skipped, fractions cut off; a negative
    number or a carriage return is an error.
    """
    lines = spark.read.text(path, lineSep="\n")
    number = F.regexp_extract("value", _NUMBER, 1)
    number = _error(F.col("value").contains("\r"), "carriage return", F.col("value"), number)
    return histogram_of_counts(lines.select(F.when(number != "", number).cast("double").alias("count")).where("count is not null"))


def _table(spark: SparkSession, path: str, schema: str, keep_place: bool = False) -> DataFrame:
    """Tab-separated lines of at least three columns; those beyond the file's are null."""
    names = [c.split() for c in schema.split(", ")]
    lines = spark.read.text(path)
    lines = (in_file_order(lines) if keep_place else lines).where("trim(value) <> ''")
    place = [c for c in lines.columns if c != "value"]
    parts = F.split("value", "\t")
    wrong = (F.size(parts) < 3) | F.get(parts, F.lit(1)).try_cast("long").isNull() | F.get(parts, F.lit(2)).try_cast("long").isNull()
    rows = lines.select(_error(wrong, "not an interval", F.col("value"), F.col("value")).alias("value"), *place).select(parts.alias("p"), *place)
    return rows.select(*(F.get("p", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)), *place)


def read_bed(spark: SparkSession, path: str, keep_place: bool = False) -> DataFrame:
    """``chrom, start, end, name, score, strand``; ``keep_place`` adds where a line stands, for :mod:`tallywood.operators.ordering`."""
    return _table(spark, path, BED, keep_place)


def read_mapped_reads(spark: SparkSession, path: str, keep_place: bool = False) -> DataFrame:
    """An interval and its bases ``seq``."""
    return _table(spark, path, MAPPED_READS, keep_place)
