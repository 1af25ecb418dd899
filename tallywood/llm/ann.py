"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A unit vector is padded, rotated and kept as the signs of its coordinates, packed into bits, with the
inner product of vector and signs as correction. From the bits alone the inner product with a query is
estimated within a bound that holds with high probability; only vectors whose upper bound reaches the
k-th largest exact product known so far are compared in full. Vectors lie in cells around the means of a
sample; a query meets only the cells whose radius lets them hold one of its neighbours, so a table with
clusters isn't searched whole, and nothing is lost by leaving cells out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.llm import _shared

#: Bits of a code for each dimension; more bits give tighter bounds.
BITS_PER_DIMENSION = 4
#: Width of the error bound in standard errors.
EPSILON = 2.5
#: Vectors of one block of codes, and queries of one block.
CODES, QUERIES = 8192, 8192
#: Cells that vectors are dealt to, at most; vectors of the sample, and its bytes.
CELLS, SAMPLE, SAMPLE_BYTES = 256, 16_384, 32 << 20
#: Lengths of vectors in one table.
MOST_LENGTHS = 16


def rotation(dims: int, bits: int, seed: int = 0) -> np.ndarray:
    """The first ``dims`` columns of a random rotation of ``bits`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms, and the corrections: inner products of unit vectors with their sign vectors."""
    norm = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norm[:, None]) @ turn.T
    signs = turned > 0
    return np.packbits(signs, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])


def bounds(signs: np.ndarray, norm: np.ndarray, correction: np.ndarray, queries: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (vectors x queries) and how far off they may be, from unpacked bits and corrections."""
    bits = turn.shape[0]
    length = np.linalg.norm(queries, axis=1)
    turned = ((queries / length[:, None]) @ turn.T).astype(np.float32)
    # sum of sign * q = 2 * sum over set bits - sum over all
    inner = (2 * (signs @ turned.T) - turned.sum(axis=1)) / np.float32(np.sqrt(bits))
    scale = (norm / correction)[:, None] * length[None, :]
    off = np.sqrt((1 - np.minimum(correction, 1) ** 2) / correction**2 / (bits - 1)) * norm
    return inner * scale, (epsilon * off)[:, None] * length[None, :]


def _usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0 becomes 0
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    return rows.where(fine)


def centres(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """At most ``n`` means of ``sample`` by Lloyd's rounds."""
    found = sample[np.random.default_rng(seed).permutation(len(sample))[:n]].copy()
    for _ in range(rounds if n > 1 else 0):
        own = _nearest_centre(sample, found)
        many = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found[many > 0] = sums[many > 0] / many[many > 0, None]
    return found


def _nearest_centre(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (vectors @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)


def nearest(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bits_per_dimension: int = BITS_PER_DIMENSION, epsilon: float = EPSILON, seed: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` rows of largest inner product, itself left out.

    ``is_query(column)`` says of a row's id whether it is a query. Scores are inner products of the
    original vectors in double precision; equal ones go to the smaller id. Null, zero and non-finite
    vectors and null ids take no part; vectors are compared with those of their own length, and more than
    MOST_LENGTHS lengths in a table are an error; of rows with one id and vector one counts. Fewer
    candidates than ``k`` give all of them. Equal vectors are searched as one and then spread out again
    over their smallest ``k + 1`` ids, so that a vector of very many copies costs no more than any other.
    With no rows, no result.
    """
    rows = _usable(table, id_col, vector_col)
    lengths = [r.n for r in rows.select(F.size("v").alias("n")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    found = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dims in sorted(lengths):
        found = found.union(_nearest(rows.where(F.size("v") == dims).distinct(), dims, is_query, k, bits_per_dimension, epsilon, seed))
    return found


def _nearest(rows: DataFrame, dims: int, is_query, k: int, bits_per_dimension: int, epsilon: float, seed: int) -> DataFrame:
    # a class for each different vector; its number is its smallest id (an id with two vectors gives two classes)
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.max(is_query(F.col("vec_id"))).alias("asks"))
    classes = _shared.cut(classes.withColumn("class", F.xxhash64("v")))
    members = _shared.cut(rows.select("vec_id", F.xxhash64("v").alias("class")))
    few = Window.partitionBy("class").orderBy("vec_id")
    spread = members.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).drop("n")
    total = classes.count()
    # a bounded sample of the vectors: for the cells, and for what a query's best is at least
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    picked = classes.where(F.shiftrightunsigned(F.xxhash64("class", F.lit(3)), 1) <= F.lit(min(1.0, most / total) * 2.0**63))
    sample = np.array(picked.select("v").limit(2 * most).toArrow().column("v").combine_chunks().flatten(), float).reshape(-1, dims)
    centre = centres(sample, max(1, min(CELLS, total // CODES)), seed=seed) if len(sample) else np.zeros((1, dims))
    turn = rotation(dims, max(64, dims * bits_per_dimension), seed)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("v").flatten()).reshape(-1, dims)
            packed, norm, correction = encode(v, turn)
            packed = pa.array([row.tobytes() for row in packed], pa.binary())
            cell = _nearest_centre(v, centre)
            radius = np.linalg.norm(v - centre[cell], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("asks"), pa.array(cell.astype(np.int32)), pa.array(radius), packed, pa.array(norm), pa.array(correction), batch.column("v")], ["class", "asks", "cell", "radius", "code", "norm", "correction", "v"])

    coded = _shared.written(classes.select("class", "asks", "v").mapInArrow(codes, "class long, asks boolean, cell int, radius double, code binary, norm double, correction double, v array<double>"))
    in_cell = {r.cell: r for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"), F.max("radius").alias("radius")).collect()}  # a row for each cell
    radius = np.array([in_cell[c].radius if c in in_cell else -np.inf for c in range(len(centre))])
    many = lambda size, field: np.array([max(1, -(-getattr(in_cell[c], field) // size)) if c in in_cell else 1 for c in range(len(centre))])
    code_blocks, query_blocks = many(CODES, "n"), many(QUERIES, "asking")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.array(batch.column("v").flatten()).reshape(-1, dims)
            # k + 1 vectors of the sample are as near as this (one may be the query's own)
            least = np.full(len(q), -np.inf)
            if len(sample) > k:
                for at in range(0, len(q), 256):
                    least[at : at + 256] = np.partition(q[at : at + 256] @ sample.T, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
            # a cell none of whose vectors can reach that is left out
            length = np.linalg.norm(q, axis=1)[:, None]
            reach = q @ centre.T + length * (radius * (1 + 1e-9) + 1e-9 * np.linalg.norm(centre, axis=1))
            i, cell = np.nonzero(reach >= (np.where(np.isfinite(least), least - 1e-9 * np.abs(least), least))[:, None])
            home = batch.column("cell").to_numpy()[i]
            block = home * 65_536 + batch.column("class").to_numpy()[i] % query_blocks[home]
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(i)), pa.array(cell.astype(np.int32)), pa.array(block), pa.array(least[i]), batch.column("v").take(pa.array(i))], ["class", "cell", "block", "least", "v"])

    # queries of one cell stay together; every block of them meets the cells that may hold its neighbours
    right = _shared.written(coded.where("asks").select("class", "cell", "v").mapInArrow(dealt, "class long, cell int, block long, least double, v array<double>"))
    parts = F.element_at(F.array(*(F.lit(int(n)) for n in code_blocks)), F.col("cell") + 1)
    meets = right.select("cell", "block").distinct().toDF("cell", "block")
    left = coded.select("class", "cell", F.pmod(F.xxhash64("class", F.lit(7)), parts).cast("int").alias("part"), "code", "norm", "correction", "v").join(meets, "cell")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            packed = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
            ids, norm, correction = left["class"].to_numpy(), left["norm"].to_numpy(), left["correction"].to_numpy()
            vectors, few = np.stack(left["v"].to_numpy()), min(k + 1, len(left))
            signs = np.unpackbits(packed, axis=1, count=turn.shape[0]).astype(np.float32)
            for at in range(0, len(right), 128):
                part = right.iloc[at : at + 128]
                asked = np.stack(part["v"].to_numpy())
                estimate, off = bounds(signs, norm, correction, asked, turn, epsilon)
                estimate += off
                # the k + 1 best of the bounds in full (one may be the query's own vector), then all that may beat them
                best = np.argpartition(estimate, len(left) - few, axis=0)[len(left) - few :]
                least = np.einsum("kqd,qd->kq", vectors[best], asked).min(axis=0)
                least = np.where(len(left) > k, np.maximum(least, part["least"].to_numpy()), part["least"].to_numpy())
                reach = estimate >= np.where(np.isfinite(least), least - 1e-6 * np.abs(least), least)[None, :]
                reach[best, np.arange(len(part))[None, :]] = True  # so that no query goes short
                i, j = np.nonzero(reach)
                score = np.einsum("nd,nd->n", vectors[i], asked[j])
                order = np.lexsort((-score, j))
                rank = np.arange(len(j)) - np.searchsorted(j[order], j[order])
                # with ties at the last place, so that what stays is the same however the blocks fall
                last = np.full(len(part), -np.inf)
                at_last = order[rank == k]
                last[j[at_last]] = score[at_last]
                keep = score >= last[j]
                out.append(pd.DataFrame({"query": part["class"].to_numpy()[j[keep]], "class": ids[i[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "class": [], "score": []})

    scored = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInPandas(cell, "query long, class long, score double")
    # the best k + 1 classes hold the best k candidates of every query in its class, and of a class its smallest ids do
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class")))
    tied = F.max(F.when(F.col("n") == k + 1, F.col("score"))).over(Window.partitionBy("query"))
    best = best.withColumn("least", tied).where("least is null or score >= least").select("query", "class", "score")
    found = best.join(spread, "class")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    asked = members.where(is_query(F.col("vec_id"))).select(F.col("class").alias("query"), F.col("vec_id").alias("query_id"))
    found = asked.join(found, "query").where("vec_id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_shared.table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)
