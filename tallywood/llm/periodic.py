"""Periodic runs of words: maximal stretches that repeat a block of words again and again.

Branching tandem repeats are found in the suffix tree of a text's words by the method of Stoye and
Gusfield: at a node of depth d the leaves of the smaller half are listed, and a leaf i makes a repeat
of block length d with i + d or i - d wherever that one is a leaf of the other half. A repeat is
then rotated to the left as far as it goes, and rotations of one stretch are merged into its run.

Texts are worked on some hundred thousand words at a time, each with a vocabulary of its own and a
sign of its own at its end, so one tree (its leaves in order, and the depths at which neighbours
part) holds them all and no repeat crosses two of them. A very long text is a tree of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import _shared
from tallywood.llm._words import spans, texts_of

RUNS = "array<struct<start: long, length: long, period: long>>"
#: Bytes of text whose words share a tree, unless one text is longer, and leaves that are listed at once.
TOGETHER, LISTED = 1 << 21, 1 << 20
#: Rounds in which all nodes look for their ends at once, before the few that are left do so in order.
ROUNDS = 40


class SuffixTree:
    """The suffix tree of ``signs`` (numbers under their count or a few more; each text's end a sign that nothing else has).

    ``leaf[k]`` is the suffix at place k in order, ``place`` the reverse; ``depth[k]`` is how far
    places k - 1 and k agree. The inner node of a depth over an interval of places is where it is
    least. ``same[t]`` numbers the stretches of 2^t signs that start at each place of the text.
    """

    def __init__(self, signs: np.ndarray):
        n = len(signs)
        leaf = np.argsort(signs, kind="stable")
        found = signs[leaf]
        new = np.ones(n, bool)
        new[1:] = found[1:] != found[:-1]
        place = np.empty(n, np.int64)
        place[leaf] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.same = [place.astype(np.int32)]
        open_ = leaf[~(new & np.append(new[1:], True))]
        width = 1
        while len(open_):  # suffixes that agree with another so far, in order of their first ``width`` signs
            group = place[open_]
            key = group * n + place[open_ + width]
            by = np.argsort(key)
            open_, key, group = open_[by], key[by], group[by]
            at = np.arange(len(open_))
            head, new = np.ones(len(open_), bool), np.ones(len(open_), bool)
            head[1:], new[1:] = group[1:] != group[:-1], key[1:] != key[:-1]
            slot = group + at - np.maximum.accumulate(np.where(head, at, 0))
            leaf[slot] = open_
            place[open_] = slot[np.maximum.accumulate(np.where(new, at, 0))]
            self.same.append(place.astype(np.int32))
            open_ = open_[~(new & np.append(new[1:], True))]
            width *= 2
        self.leaf, self.place = leaf, place
        self.depth = np.zeros(n + 1, np.int64)
        pair = np.flatnonzero(self.same[0][leaf[1:]] == self.same[0][leaf[:-1]]) + 1
        self.depth[pair] = self.agree(leaf[pair - 1], leaf[pair])

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many signs from ``a`` and from ``b`` on are the same; ``a`` and ``b`` differ."""
        out = np.zeros(len(a), np.int64)
        for t in range(len(self.same) - 1, -1, -1):
            out += (self.same[t][a + out] == self.same[t][b + out]).astype(np.int64) << t
        return out

    def agree_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many signs before ``a`` and before ``b`` are the same; ``a`` < ``b``."""
        out = np.zeros(len(a), np.int64)
        for t in range(len(self.same) - 1, -1, -1):
            x = a - out - (1 << t)
            out += ((x >= 0) & (self.same[t][np.maximum(x, 0)] == self.same[t][np.maximum(b - out - (1 << t), 0)])).astype(np.int64) << t
        return out

    def nodes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inner nodes of ``least`` leaves or more: leaves at places ``lo`` to ``mid`` part from those at ``mid`` to ``hi`` there."""
        depth = self.depth
        mid = np.flatnonzero(depth)
        lo = self._ends(mid, np.arange(-1, len(depth) - 1), lambda x, k: depth[x] >= depth[k])[mid]
        hi = self._ends(mid[::-1], np.append(np.arange(1, len(depth)), len(depth) - 1), lambda x, k: depth[x] > depth[k])[mid]
        many = hi - lo >= least
        return lo[many], mid[many], hi[many]

    @staticmethod
    def _ends(nodes: np.ndarray, end: np.ndarray, goes_on) -> np.ndarray:
        """``end`` of each node moved along until ``goes_on`` is false; nodes in the order in which later ones build on earlier."""
        left = nodes[goes_on(end[nodes], nodes)]
        for _ in range(ROUNDS):
            if not len(left):
                return end
            end[left] = end[end[left]]
            left = left[goes_on(end[left], left)]
        for k in left.tolist():
            x = end[k]
            while goes_on(x, k):
                x = end[x]
            end[k] = x
        return end

    def tandems(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """``start, block`` of the branching tandem repeats whose block occurs ``least`` times or more."""
        lo, mid, hi = self.nodes(least)
        left = mid - lo <= hi - mid
        begin, size = np.where(left, lo, mid), np.where(left, mid - lo, hi - mid)
        other, end = np.where(left, mid, lo), np.where(left, hi, mid)
        block = self.depth[mid]
        starts, blocks = [], []
        upto = np.cumsum(size)
        first = 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + LISTED, "right")))
            many = size[first:last]
            node = np.repeat(np.arange(first, last), many)
            leaf = self.leaf[np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + begin[node]]
            d = block[node]
            for start, mate in ((leaf, leaf + d), (leaf - d, leaf - d)):
                at = self.place[np.maximum(mate, 0)]
                hit = (mate >= 0) & (at >= other[node]) & (at < end[node])
                starts.append(start[hit])
                blocks.append(d[hit])
            first = last
        return (np.concatenate(starts), np.concatenate(blocks)) if starts else (np.empty(0, np.int64),) * 2

    def runs(self, least: int, times: int) -> np.ndarray:
        """Rows ``start, length, period`` of the maximal runs of ``max(least, times * period)`` signs or more, in order; ``times`` is 2 or more."""
        start, block = self.tandems(times)
        end = start + 2 * block
        start = start - self.agree_before(start, start + block)  # as far as the repeat can be rotated
        long = end - start >= np.maximum(least, times * block)
        start, end, block = start[long], end[long], block[long]
        by = np.lexsort((block, end, start))
        start, end, block = start[by], end[by], block[by]
        new = np.ones(len(start), bool)  # of one stretch, the first has its least period
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return np.stack([start, end - start, block], 1)[new]


def runs_of(words: list[list[bytes]], least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The runs of every list of words, and the bounds of each list's in them; starts count from its first word."""
    signs, begin, base, at = [], [], 0, 0
    for row in words:
        known = dict(zip(dict.fromkeys(row), range(base, base + len(row)), strict=False))
        part = np.empty(len(row) + 1, np.int64)
        part[:-1] = np.fromiter(map(known.__getitem__, row), np.int64, len(row))
        part[-1] = base = base + len(known)
        base += 1
        signs.append(part)
        begin.append(at)
        at += len(part)
    if not at:
        return np.empty((0, 3), np.int64), np.zeros(len(words) + 1, np.int64)
    found = SuffixTree(np.concatenate(signs)).runs(least, times)
    begin = np.array(begin)
    row = np.searchsorted(begin, found[:, 0], "right") - 1
    found[:, 0] -= begin[row]
    return found, np.searchsorted(row, np.arange(len(words) + 1))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run has after its first period, with one space between them."""
    if len(runs):
        kept = np.ones(len(words), bool)
        for start, length, period in runs.tolist():
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs``.

    Words stand between white space (ASCII). A run is a stretch with a least period, of
    ``max(least, times * period)`` words or more (``times`` at least 2), that goes on with this
    period on neither side; ``runs`` has their start (from 0), length and period by start, then
    period, and ``collapsed`` is the text without what a run repeats, one space between words. A null
    or empty text has no words, no runs and an empty collapsed text. A row that occurs twice is
    answered twice; ids may be null; other columns, whatever their names, are left out; an empty
    table gives no rows.
    """
    if times < 2:
        raise ValueError("a run repeats its period twice or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch.column(1))
            for lo, hi in spans(off, TOGETHER):
                words = [data[a:b].tobytes().split() for a, b in zip(off[lo:hi].tolist(), off[lo + 1 : hi + 1].tolist(), strict=True)]
                runs, at = runs_of(words, least, times)
                texts = [collapsed(w, runs[a:b]) for w, a, b in zip(words, at[:-1].tolist(), at[1:].tolist(), strict=True)]
                rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
                columns = [batch.column(0)[lo:hi], pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of one document in ten, by the crc32 of its id, the words from some place on repeat a block of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    own = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    own = own.select("doc_id", "text", "g", words.alias("w"))
    own = own.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    own = own.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform("w", lambda w, i: F.when(i >= F.col("a"), F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))).otherwise(w))
    return own.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """What :func:`periodic_runs` found as its number of runs, its longest run and checksums."""

    def best(field: str) -> Column:
        return F.col("best")[field]

    text = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    rows = rows.select("doc_id", "runs", "collapsed", F.array_min(order).alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best("start").alias("start"), best("length").alias("length"), best("period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(with_periods(_shared.table(spark, sf_dir, "documents"))))
