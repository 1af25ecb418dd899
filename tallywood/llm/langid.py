"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled
windows. It labels every byte of a text; a text's language probabilities are the means over its
bytes. Texts run through it in windows of a fixed number of bytes, thousands of windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.llm import _shared
from tallywood.llm._words import spans, texts_of

#: Bytes of one window.
WINDOW = 64
#: Windows that run through the network together.
TOGETHER = 1024
#: Windows of labelled text that are learned from, for each language.
WINDOWS_PER_LANGUAGE = 1500
HIDDEN = 8
#: The byte value that fills up a text's last window.
PAD = 256
UNKNOWN = "und"


def _squash(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: a cheap sigmoid from -1 to 1; its slope is (1 - |value|) squared."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare
    return x


def _steps(table: np.ndarray, steps: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, hidden, windows) of one direction; ``table`` has the input shares of the gates (3 hidden, bytes)."""
    hidden, (time, n) = u.shape[1], steps.shape
    states, kept = np.empty((time, hidden, n), np.float32), []
    h, spare = np.zeros((hidden, n), np.float32), np.empty((2 * hidden, n), np.float32)
    parts, own = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
    for t in range(time):
        if keep:
            parts, own = np.empty_like(parts), np.empty_like(own)
        np.take(table, steps[t], axis=1, out=parts, mode="clip")
        np.matmul(u, h, out=own)
        gates, fresh = parts[: 2 * hidden], parts[2 * hidden :]
        gates += own[: 2 * hidden]
        _squash(gates, spare)
        gates *= 0.5
        gates += 0.5  # update and reset gates
        z, r = gates[:hidden], gates[hidden:]
        np.multiply(r, own[2 * hidden :], out=spare[:hidden])
        fresh += spare[:hidden]
        _squash(fresh, spare[:hidden])
        if keep:
            kept.append((h, z, r, fresh, own[2 * hidden :]))
        np.subtract(h, fresh, out=states[t])
        h = states[t]
        h *= z
        h += fresh
    return states, kept


@dataclass
class ByteNetwork:
    """``tables``: gate inputs of every byte for both directions, with the biases; ``us``: recurrent weights; ``v``, ``c``: output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    us: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(languages, [draw(3 * hidden, 257, by=0.3) for _ in "fb"], [draw(3 * hidden, hidden, by=hidden**-0.5) for _ in "fb"], draw(len(languages), 2 * hidden, by=0.3), np.zeros((len(languages), 1), np.float32))

    def _forward(self, windows: np.ndarray, keep: bool = False) -> tuple[list, list, np.ndarray]:
        hidden, states, kept = self.us[0].shape[1], [], []
        for k in range(2):
            steps = windows.T if k == 0 else windows.T[::-1]
            s, x = _steps(self.tables[k], np.ascontiguousarray(steps), self.us[k], keep)
            states.append(s if k == 0 else s[::-1])
            kept.append(x)
        logits = np.matmul(self.v[:, :hidden], states[0])
        logits += np.matmul(self.v[:, hidden:], states[1])
        logits += self.c
        np.minimum(logits, 60, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return states, kept, logits  # (time, languages, windows)

    def labels(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities of every byte: (time, languages, windows)."""
        return self._forward(windows)[2]

    def gradients(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss per byte and its gradients by backpropagation through time over whole windows."""
        states, kept, p = self._forward(windows, keep=True)
        time, n = windows.shape[1], len(windows)
        hidden = self.us[0].shape[1]
        counted = (windows.T != PAD) * weight / (time * n)
        loss = float(-(np.log(p[:, target, np.arange(n)] + 1e-9) * counted).sum())
        d = p.copy()
        d[:, target, np.arange(n)] -= 1
        d *= counted[:, None, :]
        d = d.astype(np.float32)
        grads = [np.zeros_like(x) for x in self.weights()]
        grads[4] = np.concatenate([np.einsum("tcn,thn->ch", d, s) for s in states], axis=1)
        grads[5] = d.sum(axis=(0, 2))[:, None]
        for k in range(2):
            into = np.matmul(self.v[:, k * hidden : (k + 1) * hidden].T, d)
            if k == 1:
                into = into[::-1]
            steps = windows.T if k == 0 else windows.T[::-1]
            u, dh, gates = self.us[k], np.zeros((hidden, n), np.float32), np.empty((3, time, hidden, n), np.float32)
            for t in range(time - 1, -1, -1):
                h, z, r, fresh, own = kept[k][t]
                dh = dh + into[t]
                da = dh * (1 - z) * (1 - np.abs(fresh)) ** 2
                dz = dh * (h - fresh) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = da * own * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                gates[0, t], gates[1, t], gates[2, t] = dz, dr, da
                through = np.concatenate([dz, dr, da * r])
                grads[2 + k] += through @ h.T
                dh = dh * z + u.T @ through
            for i in range(3 * hidden):
                grads[k][i] = np.bincount(steps.ravel(), gates[i // hidden, :, i % hidden].ravel(), 257)
        return loss, grads

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.us, self.v, self.c]


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = 600, batch: int = 256, rate: float = 0.02, seed: int = 0) -> ByteNetwork:
    """Adam over random batches; every language weighs the same however many windows it has."""
    net, rng = ByteNetwork.fresh(languages, hidden, seed), np.random.default_rng(seed)
    weight = (len(target) / len(languages) / np.maximum(np.bincount(target, minlength=len(languages)), 1))[target]
    first, second = [np.zeros_like(x) for x in net.weights()], [np.zeros_like(x) for x in net.weights()]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), min(batch, 4 * len(windows)))
        _, grads = net.gradients(windows[pick], target[pick], weight[pick])
        slower = rate * (1 - 0.95 * step / steps)
        for w, g, m, s in zip(net.weights(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= slower * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the rows in windows of ``size``, the last of a row filled up; and each window's row."""
    length = np.diff(offsets)
    many = -(-length // size)
    row = np.repeat(np.arange(len(many)), many)
    begin = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * size
    at = begin[:, None] + np.arange(size)
    inside = at < offsets[row + 1][:, None]
    if not len(row):
        return np.empty((0, size), np.int64), row
    # a byte has no room for PAD, so the bytes are widened first
    return np.where(inside, data[np.where(inside, at, 0)].astype(np.int64), PAD), row


def sample_windows(docs: DataFrame, per_language: int = WINDOWS_PER_LANGUAGE, window: int = WINDOW, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, part``: at most ``per_language`` labelled stretches of ``window`` characters, of different texts.

    Rows are picked, and the stretch within a text placed, by hashes of the text: those of the least
    hashes. What can't be among them, by a count of a language's texts, goes before anything moves, so
    a task sorts a few times ``per_language`` rows however many a language has.
    """
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and length(text) > 0")
    own = own.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    # about so many different texts, to 5 %; twice the share that is wanted holds enough of them
    counts = own.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    most = F.when(F.col("n") <= 2 * per_language, F.lit(2.0**63)).otherwise(2.0 * per_language / F.col("n") * 2.0**63)
    # a row for each language, of which the network has an output each
    own = own.join(F.broadcast(counts.select("lang", most.alias("most"))), "lang").where(F.col("h") <= F.col("most"))
    own = own.withColumn("at", F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - window, F.lit(1))).cast("int") + 1)
    own = own.select("lang", "h", F.expr(f"substring(text, at, {window})").alias("part")).distinct()
    return own.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("n") <= per_language).select("lang", "part")


def learn(docs: DataFrame, **options) -> ByteNetwork | None:
    """A network for the languages that label ``docs``; None where no row has both a text and a language."""
    rows = sorted((r.lang, r.part) for r in sample_windows(docs).collect())  # at most WINDOWS_PER_LANGUAGE of a language
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    windows, row = windows_of(*texts_of(pa.array([part for _, part in rows], pa.string())))
    return train(windows, np.array([languages.index(lang) for lang, _ in rows])[row], languages, **options)


def identify(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the likeliest language and its pooled probability.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Every byte
    of every text is labelled. Rows are told apart by nothing but themselves, so repeated rows give
    repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            known, names, scores = batch.column(2).to_numpy(zero_copy_only=False), [], []
            for lo, hi in spans(offsets, 1 << 18):
                pooled = np.zeros((hi - lo, len(net.languages)))
                windows, row = windows_of(data, offsets[lo : hi + 1])
                for at in range(0, len(windows), TOGETHER):
                    part, own = windows[at : at + TOGETHER], row[at : at + TOGETHER]
                    p = net.labels(part)
                    p *= (part.T != PAD)[:, None, :]
                    p = p.sum(axis=0)
                    for k in range(len(net.languages)):
                        pooled[:, k] += np.bincount(own, p[k], hi - lo)
                pooled /= np.maximum(np.diff(offsets[lo : hi + 1]), 1)[:, None]
                best = pooled.argmax(axis=1)
                names += [net.languages[b] if k else UNKNOWN for b, k in zip(best, known[lo:hi], strict=True)]
                scores += [min(1.0, float(s)) if k else 0.0 for s, k in zip(pooled[np.arange(hi - lo), best], known[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if net is None:
        return own.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    own = own.withColumn("known", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(_shared.fold("doc_id", 5) != 0)))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (_shared.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
