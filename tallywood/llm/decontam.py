"""Benchmark passages in documents by Wu-Manber search over word hashes.

Patterns are windows of consecutive words of the benchmark items. A block of words ending at a cursor
looks up how far the cursor may jump; a block that ends a pattern has shift 0, and its suffix-hash
bucket, narrowed by the prefix hash, names the patterns that are compared with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import _shared
from tallywood.llm._words import ALNUM, U, Words, mix, spans, texts_of, words_of

#: Bytes of benchmark text searched for in one pass; more text takes more passes.
PASS_BYTES = 8 << 20
#: Words of a part of a long benchmark item.
PART_WORDS = 50_000
#: Cursors per text: a lane of so many words has one.
LANE = 128
HITS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
FOUND = "doc_id long, n_words long, hits array<struct<start:long,stop:long>>, items array<string>"


class Patterns:
    """Shift table and buckets of the windows of ``m`` words; all of it arrays over the words of one pass.

    ``at`` are the windows' first words among ``words`` (and ``hashes``), ``item`` the items they are of.
    """

    def __init__(self, words: Words, hashes: np.ndarray, at: np.ndarray, item: np.ndarray, m: int):
        self.words, self.hashes, self.m = words, hashes, m
        self.block = min(3, m)
        self.jump = m - self.block + 1
        bits = max(12, int(len(at) * 8).bit_length())
        self.mask = U((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.jump, np.uint8)
        for end in range(self.block, m + 1):
            slot = (self._blocks(hashes, at + end - 1) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slot, m - end)
        key = self._key(self._blocks(hashes, at + m - 1), self._blocks(hashes, at + self.block - 1))
        order = np.lexsort((item, key))
        self.key, self.at, self.item = key[order], at[order].astype(np.int32), item[order].astype(np.int32)

    @staticmethod
    def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return mix(suffix) ^ prefix

    def _blocks(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the blocks whose last words are at ``end``."""
        out = np.zeros(len(end), U)
        for k in range(self.block - 1, -1, -1):
            out = mix(out + words[end - k])
        return out

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and numbers of the patterns whose hashes stand in the rows; still to be compared as text."""
        begin, stop = first[:-1] + self.m - 1, first[1:]
        lanes = np.maximum(0, -(-(stop - begin) // LANE))
        total = int(lanes.sum())
        if not total:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        in_row = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        cursor = np.repeat(begin, lanes) + in_row * LANE
        limit = np.minimum(cursor + LANE, np.repeat(stop, lanes))
        ends, suffixes = [], []
        while len(cursor):
            hashed = self._blocks(words, cursor)
            jump = self.shift[(hashed & self.mask).astype(np.int64)].astype(np.int64)
            here = jump == 0
            if here.any():
                ends.append(cursor[here])
                suffixes.append(hashed[here])
            cursor = cursor + np.maximum(jump, 1)
            going = cursor < limit
            cursor, limit = cursor[going], limit[going]
        if not ends:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        end, suffix = np.concatenate(ends), np.concatenate(suffixes)
        key = self._key(suffix, self._blocks(words, end - self.m + self.block))
        lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        many = hi - lo
        which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(end, many) - self.m + 1
        same = np.ones(len(start), bool)
        for k in range(self.m):
            same &= words[start + k] == self.hashes[self.at[which] + k]
        return start[same], which[same]

    def text(self, which: int) -> bytes:
        return self.words.text(int(self.at[which]), int(self.at[which]) + self.m)


def compile_patterns(items: list[tuple[str, str]], window: int) -> tuple[list[Patterns], list[str]]:
    """The windows of ``items(name, text)`` by their numbers of words; a name may have several parts."""
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    words = words_of(*texts_of(pa.array([t for _, t in items], pa.large_string())), ALNUM)
    words.starts, words.ends = words.starts.astype(np.int32), words.ends.astype(np.int32)
    hashes, size = words.hashes(), np.diff(words.first)
    owner = np.array([number[n] for n, _ in items], np.int32)
    out = []
    for m in sorted({min(window, int(n)) for n in np.unique(size) if n}):
        rows = np.flatnonzero(size == m if m < window else size >= window)
        many = size[rows] - m + 1
        at = np.repeat(words.first[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
        out.append(Patterns(words, hashes, at, np.repeat(owner[rows], many), m))
    return out, names


def _parts(items: DataFrame, window: int) -> DataFrame:
    """``item, text``: items of more than PART_WORDS words in parts that overlap, so that each window is in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for lo, hi in spans(offsets):
                words = words_of(data, offsets[lo : hi + 1], ALNUM)
                for r in range(hi - lo):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    for at in range(a, b if b - a > PART_WORDS else min(b, a + 1), PART_WORDS):
                        end = b if b - a <= PART_WORDS else min(b, at + PART_WORDS + window - 1)
                        if at == a or end - at >= window:
                            yield pa.RecordBatch.from_arrays([batch.column("item").slice(lo + r, 1), pa.array([words.data[words.starts[at] : words.ends[end - 1]].tobytes().decode()], pa.string())], ["item", "text"])

    return items.mapInArrow(run, "item string, text string")


def _pass(docs: DataFrame, patterns: list[Patterns], names: list[str]) -> DataFrame:
    """What one block of patterns hits of ``docs(doc_id, text)``, and the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            counts, hits, items = [], [], []
            for lo, hi in spans(offsets):
                words = words_of(data, offsets[lo : hi + 1], ALNUM)
                hashes, ends = words.hashes(), words.first
                seen: dict[int, tuple[list, set]] = {}
                for p in patterns:
                    start, which = p.search(hashes, ends)
                    rows = np.searchsorted(ends, start, "right") - 1
                    for s, w, r in zip(start.tolist(), which.tolist(), rows.tolist(), strict=True):
                        if words.text(s, s + p.m) == p.text(w):
                            at = seen.setdefault(r, ([], set()))
                            at[0].append((s - int(ends[r]), s - int(ends[r]) + p.m))
                            at[1].add(int(p.item[w]))
                counts += np.diff(ends).tolist()
                hits += [seen[r][0] if r in seen else [] for r in range(hi - lo)]
                items += [sorted(names[i] for i in seen[r][1]) if r in seen else [] for r in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([_joined(h) for h in hits], HITS), pa.array(items, pa.list_(pa.string()))], ["digest", "doc_id", "n_words", "hits", "items"])

    return docs.mapInArrow(run, f"digest string, {FOUND}").select("doc_id", "digest", "n_words", "hits", "items")


def _joined(hits: list[tuple[int, int]]) -> list[dict]:
    """Disjoint ranges in order that cover what ``hits`` do."""
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


def _together(rows: DataFrame) -> DataFrame:
    """``rows`` with the hits and items of the last pass and those of the passes before (``more``) as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = [], []
            for own, its, more in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), batch.column("more").to_pylist(), strict=True):
                rest = more or []
                hits.append(_joined([(x["start"], x["stop"]) for x in own] + [(x["start"], x["stop"]) for m in rest for x in m["hits"]]))
                items.append(sorted({*its, *(i for m in rest for i in m["items"])}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, HITS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])

    return rows.mapInArrow(run, FOUND)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``doc_id, n_words, hits, items`` for every row of ``docs``.

    ``hits`` are the disjoint word ranges that occurrences of benchmark windows cover, ``items`` the
    ids (as strings) of the items they come from. An item of fewer words than ``window`` is one
    pattern; one without words or with a null text or id is none. Null and empty texts have no
    words; rows with one id are each their own document. A benchmark of more than ``pass_bytes`` is
    searched for in several passes, each a job that reads the texts again, so that a task holds the
    tables of one. Of a pass the driver and each task hold the text and arrays of about 60 bytes
    for each of its words (some ten times the text, measured in a test); long items are cut into parts before.
    """
    own = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    size, longest = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-size // pass_bytes))
    if longest > 2 * PART_WORDS:  # only then can an item have more words than a part
        own = _parts(own, window)
    # hits depend on the text alone, by which those of several passes meet; each pass is a job of its own
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.md5(text) if passes > 1 else F.lit(None).cast("string")).alias("digest"), text.alias("text"))
    before = []
    for k in range(passes):
        block = own if passes == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        patterns, names = compile_patterns([(r.item, r.text) for r in block.collect()], window)
        found = _pass(rows, patterns, names)
        if k + 1 < passes:
            # of copies of a text one row; what has no hit isn't kept
            some = found.where(F.size("items") > 0).groupBy("digest").agg(F.first(F.struct("hits", "items")).alias("of"))
            before.append(_shared.written(some))
    if not before:
        return found.drop("digest")
    more = reduce(DataFrame.union, before).groupBy("digest").agg(F.collect_list("of").alias("more"))
    return _together(found.join(more, "digest", "left"))


def contaminated(found: DataFrame, one_in: int = 20) -> DataFrame:
    """``found`` with ``n_hit`` and whether at least one word in ``one_in`` is hit."""
    found = found.withColumn("n_hit", F.expr("aggregate(hits, 0L, (n, h) -> n + h.stop - h.start)"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(find_passages(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
