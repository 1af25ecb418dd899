"""Spark helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs on this machine alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: Where this is set, the shuffle files of an action go when it ends, and not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _leaving_no_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files: what it wrote is read from the shared folder."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there."""
    folder(df.sparkSession)
    with _leaving_no_shuffles(df.sparkSession):
        # the setting holds for what is planned from here on, so the action gets a plan of its own
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but as Parquet: for wide or long tables of which later steps read some columns."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _leaving_no_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first(df: DataFrame):
    """The first row of ``df``, or None."""
    with _leaving_no_shuffles(df.sparkSession):
        return df.first()


def count(df: DataFrame) -> int:
    return first(df.agg(F.count("*")))[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(docs: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``docs`` has."""
    taken, out, k = {c.lower() for c in docs.columns}, [], 0
    while len(out) < n:
        if (name := f"inner_{k}") not in taken:
            out.append(name)
        k += 1
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, parts: int):
    """The remainder that deals documents to folds: crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows of the ids in ``rejected``; rows with a null id stay."""
    name = fresh(docs, 1)[0]
    gone = rejected.select(F.col(rejected.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node it is connected to.

    Alternating large-star and small-star rounds, each a few aggregations and joins, until nothing
    changes; a node of very many links is only ever aggregated or dealt out by a skew-aware join.
    Null ends and self links are ignored. No links give no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        now = tuple(first(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))))
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.union(roots.join(found, "node", "left_anti"))
