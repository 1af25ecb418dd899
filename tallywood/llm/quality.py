"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics are computed over whole texts. Each partition sums its own normal equations; only
their sums meet. Scores of the rows that the ridge fit leaves out are calibrated by pooling adjacent
violators over a histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import _shared
from tallywood.llm._words import NONSPACE, shingles, spans, texts_of, words_of

#: Statistics of a text, in this order.
STATISTICS = ("log_bytes", "log_words", "word_bytes", "word_spread", "upper", "digit", "space", "newline", "other_byte", "punct", "comma_stop", "symbol", "repeated_byte", "distinct_words", "distinct_pairs", "repeated_lines", "line_words", "caps_words", "digit_words", "symbol_words", "top_word")
#: Random features; the normal equations have so many rows and columns.
FEATURES = 192
#: Bins of raw scores that the calibration is fitted on.
BINS = 400
#: Partitions that sum normal equations; so many sums meet on the driver.
SUMS = 32

_KIND = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 control, 6 comma or stop, 7 other punctuation, 8 symbol, 9 non-ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[9], _KIND[10], _KIND[128:] = 0, 1, 2, 3, 3, 4, 9
_KIND[[ord(c) for c in ",."]] = 6
_KIND[[ord(c) for c in "!?;:'\"()-"]] = 7
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 8


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many different hashes, and how often the commonest occurs."""
    many, most = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            x = np.sort(hashes[a:b])
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            many[r], most[r] = len(edge) - 1, np.diff(edge).max()
    return many, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    at = offsets - offsets[0]
    n_bytes = np.diff(at)
    words = words_of(data, offsets, NONSPACE)
    kind, first = _KIND[words.data], words.first
    n_words, size = np.diff(first), words.ends - words.starts
    share = lambda flags: _per_row(flags, at) / np.maximum(n_bytes, 1)
    of_words = lambda x: _per_row(x, first) / np.maximum(n_words, 1)
    same = np.zeros(len(kind), bool)
    same[1:] = words.data[1:] == words.data[:-1]
    same[at[:-1][at[:-1] < len(same)]] = False
    sums = {k: np.concatenate([[0], np.cumsum(kind == k)]) for k in (0, 1, 2, 8)}
    inside = {k: s[words.ends] - s[words.starts] for k, s in sums.items()}
    hashes = words.hashes()
    distinct, top = _distinct(hashes, first)
    distinct_pairs, _ = _distinct(*shingles(hashes, first, 2))
    line = words_of(data, offsets, np.arange(256) != 10)
    distinct_lines, _ = _distinct(line.hashes(), line.first)
    lines = np.diff(line.first)
    mean = of_words(size)
    columns = [
        np.log1p(n_bytes), np.log1p(n_words), mean, np.sqrt(np.maximum(of_words(size.astype(np.int64) ** 2) - mean**2, 0)),
        share(kind == 1), share(kind == 2), share(kind == 3), share(kind == 4), share(kind == 9), share(kind == 7), share(kind == 6), share(kind == 8), share(same),
        distinct / np.maximum(n_words, 1), distinct_pairs / np.maximum(n_words, 1), 1 - distinct_lines / np.maximum(lines, 1), np.log1p(n_words / np.maximum(lines, 1)),
        of_words((inside[1] > 1) & (inside[0] == 0)), of_words(inside[2] > 0), of_words(inside[8] > 0), top / np.maximum(n_words, 1),
    ]
    out = np.stack([np.asarray(c, float) for c in columns], axis=1)
    out[:, 15][lines == 0] = 0
    return out


@dataclass
class QualityModel:
    """``score(texts)``; without any label every score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    calibrated: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.edges, self.calibrated)


def isotonic(position: np.ndarray, positives: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and non-decreasing shares by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for x, p, n in zip(position, positives, total, strict=True):
        blocks.append([x, x, float(p), float(n)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, p1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + p1, blocks[-1][3] + n1]
    edges = [e for lo, hi, _, _ in blocks for e in ((lo,) if lo == hi else (lo, hi))]
    shares = [p / n for lo, hi, p, n in blocks for _ in range(1 + (lo != hi))]
    return np.array(edges), np.array(shares)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` for every row: the statistics of its whole text, null counting as empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            stats = np.concatenate([statistics(data, offsets[lo : hi + 1]) for lo, hi in spans(offsets)] or [np.empty((0, len(STATISTICS)))])
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * len(STATISTICS), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), own], ["doc_id", "stats"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, stats array<double>")


def fit(labelled: DataFrame, label_col: str = "quality", ridge: float = 1.0, seed: int = 0) -> QualityModel:
    """Learn from all rows of ``labelled`` with ``stats`` and a label 0 or 1.

    Four fifths, by a hash of the statistics, fit the ridge; the rest calibrate it. Rows with other
    or null labels are left out.
    """
    rows = labelled.select("stats", F.col(label_col).cast("int").alias("_y"), F.pmod(F.xxhash64("stats"), F.lit(5)).cast("int").alias("_fold"))
    rows = _shared.cut(rows.where("_y in (0, 1)"))
    k = len(STATISTICS)
    got = rows.agg(*(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)), *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k))).first()
    rng = np.random.default_rng(seed)
    if got["m0"] is None:
        return QualityModel(np.zeros(k), np.ones(k), np.zeros((k, FEATURES)), np.zeros(FEATURES))
    mean, scale = np.array([got[f"m{i}"] for i in range(k)]), np.maximum([got[f"s{i}"] for i in range(k)], 1e-6)
    model = QualityModel(mean, scale, rng.standard_normal((k, FEATURES)) / np.sqrt(k) * 1.5, rng.uniform(0, 2 * np.pi, FEATURES))
    width = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = np.zeros((width, width)), np.zeros(width), 0
        for batch in batches:
            stats = np.array(batch.column("stats").flatten()).reshape(-1, k)
            if len(stats):
                z = model.features(stats)
                left += z.T @ z
                right += z.T @ batch.column("_y").to_numpy()
                n += len(stats)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([left.ravel(), right]).tobytes()], pa.binary())], ["sums"])

    parts = rows.where("_fold <> 0").repartition(SUMS).mapInArrow(sums, "sums binary").collect()  # at most SUMS rows
    total = sum((np.frombuffer(r["sums"]) for r in parts), np.zeros(width * width + width))
    left, right = total[: width * width].reshape(width, width), total[width * width :]
    model.weights = np.linalg.solve(left + ridge * np.diag([*[1.0] * FEATURES, 1e-6]), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(np.array(batch.column("stats").flatten()).reshape(-1, k))
            at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("_y")], ["bin", "y"])

    fold = "_fold = 0" if rows.where("_fold = 0").limit(1).count() else "true"
    bins = rows.where(fold).mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("bin").collect()  # at most BINS rows
    middle = np.array([(r.bin + 0.5) / BINS * 2 - 0.5 for r in bins])
    model.edges, model.calibrated = isotonic(middle, np.array([r.p for r in bins]), np.array([r.n for r in bins]))
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` for every row of ``stats(doc_id, stats)``: 0 to 1, higher where label 1 is likelier."""
    kind = dict(stats.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(np.array(batch.column("stats").flatten()).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(scores, 0, 1))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _shared.cut(with_statistics(_shared.table(spark, sf_dir, "documents")))
    labels = _shared.table(spark, sf_dir, "labels").select("doc_id", "quality").where((_shared.fold("doc_id", 4) != 2) & F.col("quality").isNotNull())
    scored = score(stats, fit(stats.join(labels, "doc_id")))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (_shared.fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
