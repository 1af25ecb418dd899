"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A signature is ``SYMBOLS`` minima of b bits. It is cut into chunks; two signatures that differ in at
most ``2 * chunks - 1`` symbols agree in some chunk but for one symbol at most, so the keys of a
document are its chunks with each symbol in turn left open: all pairs within the distance share a key.
What shares a key is compared by its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import _link, _shared
from tallywood.llm._words import NONSPACE, U, mix, shingles, spans, texts_of, words_of

SYMBOLS, BITS = 40, 16
#: Pairs of exactly the least similarity that may lie beyond the signature distance.
MISSED = 1e-4


def chunks_for(similarity: float, symbols: int = SYMBOLS, missed: float = MISSED) -> int:
    """The fewest chunks whose guaranteed distance misses at most ``missed`` of the pairs that are just similar enough."""
    differ = 1 - similarity
    for chunks in range(1, symbols // 2):
        beyond = sum(comb(symbols, d) * differ**d * similarity ** (symbols - d) for d in range(2 * chunks, symbols + 1))
        if beyond <= missed:
            return chunks
    return symbols // 2


def signatures(sets: np.ndarray, bounds: np.ndarray, symbols: int = SYMBOLS, bits: int = BITS) -> np.ndarray:
    """MinHash symbols (rows x symbols) of sets that follow one another; an empty set has zeros."""
    many = np.diff(bounds)
    out = np.zeros((len(many), symbols), np.uint16)
    full = np.flatnonzero(many > 0)
    if len(full):
        for k in range(symbols):
            a = mix(np.array([2 * k + 1], U))[0] | U(1)
            least = np.minimum.reduceat((sets ^ (sets >> U(29))) * a, bounds[:-1][full])
            out[full, k] = (mix(least + U(k)) & U((1 << bits) - 1)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray, chunks: int) -> np.ndarray:
    """Keys (rows x symbols): each symbol left open in its chunk."""
    out, at = np.empty(signature.shape, U), 0
    for c, part in enumerate(np.array_split(np.arange(signature.shape[1]), chunks)):
        for hole in part:
            key = np.full(len(signature), U(1000 * c + 1))
            for k in part:
                key = mix(key * U(0xD6E8FEB86659FD93) + (U(1 << 20) if k == hole else signature[:, k].astype(U)))
            out[:, at] = key
            at += 1
    return out


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's sorted distinct hashes, and their bounds."""
    rows = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(rows) if rows else np.empty(0, U), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def sketch(docs: DataFrame, width: int, chunks: int) -> DataFrame:
    """``doc_id, n_shingles, set_1, set_2, keys``: a document's set size, its set's name and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for lo, hi in spans(offsets):
                words = words_of(data, offsets[lo : hi + 1], NONSPACE)
                sets, bounds = distinct_sets(*shingles(words.hashes(), words.first, width))
                keys = chunk_keys(signatures(sets, bounds), chunks)
                names = []
                for salt in (11, 13):
                    sums = np.concatenate([[U(0)], np.cumsum(mix(sets + U(salt)))])
                    names.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U)).view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * SYMBOLS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(bounds)), *map(pa.array, names), listed], ["doc_id", "n_shingles", "set_1", "set_2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_1 long, set_2 long, keys array<long>")


def sets_of_texts(texts: DataFrame, width: int) -> DataFrame:
    """``node, hashes``: the whole sets of ``texts(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for lo, hi in spans(offsets):
                words = words_of(data, offsets[lo : hi + 1], NONSPACE)
                sets, bounds = distinct_sets(*shingles(words.hashes(), words.first, width))
                whole = [sets[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array(whole, pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents whose sets of ``width``-word shingles have at least ``percent`` hundredths of their
    union in common are linked; ``component_id`` is the least id reachable, ``kept`` whether it is
    the document's own. A text of fewer words is one shingle; a null text or one without words has
    no set and no link. Rows with one id count as copies of one document if their texts are equal
    sets, else the id stands for each of them. A row with a null id takes no part: its
    ``component_id`` is null and it is kept.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _shared.cut(sketch(own, width, chunks_for(percent / 100)))
    # equal sets are one node, named by its least id
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("set_1", "set_2", "n_shingles").agg(F.min("doc_id").alias("node"))
    members = _shared.cut(some.select("doc_id", "set_1", "set_2", "n_shingles").join(classes, ["set_1", "set_2", "n_shingles"]))
    first = members.where("doc_id = node").select("doc_id", "set_1", "set_2", F.col("n_shingles").alias("size")).distinct()
    keys = rows.join(first, ["doc_id", "set_1", "set_2"], "left_semi").select(F.explode(F.array_distinct("keys")).alias("key"), F.col("doc_id").alias("node"))
    nodes = first.groupBy(F.col("doc_id").alias("node")).agg(F.max("size").alias("size"))

    def sets_of(few: DataFrame) -> DataFrame:
        texts = own.select(F.col("doc_id").alias("node"), "text").join(few.distinct(), "node", "left_semi")
        return sets_of_texts(texts, width)

    found = _link.linked(nodes, _link.members(keys), sets_of, 100, percent)
    named = members.join(found, "node", "left").select("doc_id", "set_1", "set_2", F.coalesce("component", "node").alias("component_id")).distinct()
    out = rows.select("doc_id", "n_shingles", "set_1", "set_2").join(named, ["doc_id", "set_1", "set_2"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_shared.table(spark, sf_dir, "documents"), width=3, percent=85)
