"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Rows with one ``doc_id`` are one document where documents are rejected; of rows equal in id and text one
stays. A row with a null id is never rejected and never linked; it may lose passages that other documents
have. Null and empty texts have no language and go. Very long texts pass whole through every stage. An
empty table passes through every stage. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import _shared, decontam, langid, linededup, neardup, packing

#: A document whose likeliest language has less than this pooled probability is of no one language, and rejected.
LEAST_LANGUAGE_SCORE = 0.55
#: Texts of fewer characters are too short to be judged by their score; they go only without a letter.
LEAST_JUDGED = 128


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language; texts without a letter, and texts of no language or of a mixture, go.

    Learned from the labelled rows of four folds of five. Where nothing is labelled all documents stay.
    """
    net = langid.learn(docs.where(_shared.fold("doc_id", 5) != 0))
    if net is None:
        return docs
    # the id and the length go through the network together, as one column
    name = _shared.fresh(docs, 1)[0]
    both = docs.select(F.struct("doc_id", F.length("text").alias("n")).alias(name), "text")
    found = langid.identify(both, net, id_col=name).select("doc_id.*", "lang_pred", "score")
    unsure = (F.col("score") < LEAST_LANGUAGE_SCORE) & (F.col("n") >= LEAST_JUDGED)
    return _shared.without(docs, found.where((F.col("lang_pred") == langid.UNKNOWN) | unsure))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of several lines that stand earlier; a text of which nothing is left goes."""
    name = _shared.fresh(docs, 1)[0]
    kept = docs.withColumnRenamed("removed_lines", name) if "removed_lines" in docs.columns else docs
    cut = linededup.remove_repeated_lines(kept)
    cut = cut.where((F.col("removed_lines") == 0) | (F.trim("text") != "")).drop("removed_lines")
    return cut.withColumnRenamed(name, "removed_lines").select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near-duplicates; of rows equal in id and text one. A row with a null id stays."""
    name = _shared.fresh(docs, 1)[0]
    kept = _shared.without(docs, neardup.near_duplicates(docs).where("not kept"))
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return kept.withColumn(name, apart).dropDuplicates(["doc_id", "text", name]).drop(name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    found = decontam.find_passages(docs, _shared.table(spark, sf_dir, "benchmark"))
    return _shared.without(docs, decontam.contaminated(found).where("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The network, the tokenizer and the components can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns lies as Parquet in the shared folder until the next is written."""
    folder = f"{_shared.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _shared.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            _shared.remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
