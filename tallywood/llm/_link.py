"""Exact similarity components among sets of hashes, from candidate keys.

Sets that share a key are candidates. Keys that overlap form groups; a group is compared at once where
that moves fewer sets than comparing each of its keys by itself, so keys with much the same members
cost once, and loose candidates that chain up across keys cost no more than their keys. Comparisons go
by cells of two bounded blocks: every candidate pair is compared or already joined, and no task holds a
whole key or group. A large cell returns only a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm import _shared

#: Sets, and hashes in them, of one block of a key.
BLOCK_SETS, BLOCK_HASHES = 1024, 1 << 19
#: Sets of a cell of which all pairs are compared at once.
SMALL_CELL = 16
#: Up to so many keys are named to all tasks (8 bytes each), so that no other key moves; more are joined by a shuffle.
MOST_NAMED = 1 << 21
#: A key and its node, as they move to meet others; and about how many of a bucket are sorted at once.
PAIR, BUCKET = np.dtype([("key", "<u8"), ("node", "<u8")]), 1 << 20


def _often(keys: DataFrame) -> DataFrame:
    """``key``: the keys that have two or more different nodes."""
    return keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")


def dealt(key: np.ndarray, node: np.ndarray, buckets: int) -> pa.RecordBatch:
    """``bucket, pairs``: keys (unsigned hashes) and their nodes, in a row for each bucket that has some."""
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    pairs = np.empty(len(key), PAIR)
    pairs["key"], pairs["node"] = key[order], node[order].view(np.uint64)
    bucket = bucket[order]
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    offsets = np.append(begin, len(bucket)).astype(np.int32) * PAIR.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), packed], ["bucket", "pairs"])


def members_of(pairs: DataFrame) -> DataFrame:
    """``key, node``, once each, of the keys with two or more different nodes among rows that :func:`dealt` made.

    Keys move as 16 bytes and not as rows, and a task sorts a bucket at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            rows = np.frombuffer(b"".join(held), PAIR)
            key, node = np.ascontiguousarray(rows["key"]), rows["node"]
            order = np.argsort(key)
            key, node = key[order], node[order]
            alike = key[1:] == key[:-1]
            several = np.append(alike, False) | np.append(False, alike)
            key, node = key[several], node[several]
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            alike = key[1:] == key[:-1]
            several = np.append(alike, False) | np.append(False, alike) if len(key) else np.empty(0, bool)
            key, node = key[several].view(np.int64), node[several].view(np.int64)
            for lo in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 16)]), pa.array(node[lo : lo + (1 << 16)])], ["key", "node"])

        now, held = None, []
        for batch in batches:
            for bucket, own in zip(batch.column("bucket").to_pylist(), batch.column("pairs"), strict=True):
                if held and bucket != now:
                    yield from shared(held)
                    held = []
                now = bucket
                held.append(own.as_py())
        if held:
            yield from shared(held)

    return pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, node long")


def members(keys: DataFrame) -> DataFrame:
    """``key, node``, once each, of the keys of ``keys(key, node)`` with two or more different nodes."""
    often = _shared.cut(_often(keys))
    named = F.broadcast(often) if _shared.count(often) <= MOST_NAMED else often
    return keys.join(named, "key").select("key", "node").distinct()


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` of ``size`` values from ``begin`` on, one after the other."""
    return flat[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]


class _Cells:
    """Rows of whole cells: cell, side, node, and its set.

    ``side`` has bit 1 for the left and bit 2 for the right; a cell's left sets are compared with its right ones.
    """

    def __init__(self, columns: list[np.ndarray], size: np.ndarray, flat: np.ndarray):
        self.columns, self.size, self.flat = columns, size, flat
        self.begin = np.cumsum(size) - size

    @classmethod
    def of(cls, batch: pa.RecordBatch, held: _Cells | None) -> _Cells:
        columns = [batch.column(c).to_numpy() for c in ("cell", "side", "node")]
        sets = batch.column("hashes").cast(pa.large_binary())
        _, offsets, data = sets.buffers()
        at = np.frombuffer(offsets, np.int64)[sets.offset : sets.offset + len(sets) + 1]
        flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view("<u8") if data is not None else np.empty(0, np.uint64)
        if held is None:
            return cls(columns, np.diff(at) // 8, flat)
        return cls([np.concatenate(x) for x in zip(held.columns, columns, strict=True)], np.concatenate([held.size, np.diff(at) // 8]), np.concatenate([held.flat, flat]))

    def rows(self, lo: int, hi: int) -> _Cells:
        end = self.begin[hi] if hi < len(self.size) else len(self.flat)
        return _Cells([c[lo:hi] for c in self.columns], self.size[lo:hi], self.flat[self.begin[lo] if lo < len(self.size) else end : end])

    def links(self, part: float, whole: float) -> list[tuple[int, int]]:
        cell, side, node = self.columns
        if not len(cell):
            return []
        edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        rows = np.diff(edge)
        out = []
        for k in np.flatnonzero(rows > SMALL_CELL):
            out += self.rows(edge[k], edge[k + 1])._large(part, whole)
        # all pairs of small cells at once
        of_cell = np.repeat(np.arange(len(rows)), rows)
        left = np.flatnonzero((side & 1 > 0) & (rows[of_cell] <= SMALL_CELL))
        for at in range(0, len(left), 1 << 14):
            i = np.repeat(left[at : at + (1 << 14)], rows[of_cell[left[at : at + (1 << 14)]]])
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            j = edge[of_cell[i]] + np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            least, most = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
            meet = (side[j] & 2 > 0) & (node[i] != node[j]) & ((side[i] != 3) | (j > i)) & (part * least >= whole * most)
            i, j = i[meet], j[meet]
            # so many pairs that their sets have some million hashes
            step = max(1, int((1 << 21) // max(1, int((self.size[i] + self.size[j]).mean() if len(i) else 1))))
            for s in range(0, len(i), step):
                a, b = i[s : s + step], j[s : s + step]
                pair = np.concatenate([np.repeat(np.arange(len(a)), self.size[a]), np.repeat(np.arange(len(b)), self.size[b])])
                values = np.concatenate([_gather(self.flat, self.begin[a], self.size[a]), _gather(self.flat, self.begin[b], self.size[b])])
                order = np.lexsort((values, pair))
                pair, values = pair[order], values[order]
                both = np.bincount(pair[1:][(values[1:] == values[:-1]) & (pair[1:] == pair[:-1])], minlength=len(a))
                fine = part * both >= whole * (self.size[a] + self.size[b] - both)
                out += list(zip(node[a[fine]].tolist(), node[b[fine]].tolist(), strict=True))
        return out

    def _large(self, part: float, whole: float) -> list[tuple[int, int]]:
        """Of one cell a forest that joins what is linked."""
        _, side, node = self.columns
        size, begin = self.size, self.begin
        flat = np.unique(self.flat, return_inverse=True)[1]
        root = np.unique(node, return_inverse=True)[1]
        seen = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
        out = []
        others = np.flatnonzero(side & 2)
        taken = _gather(flat, begin[others], size[others])
        at = np.concatenate([[0], np.cumsum(size[others])])
        for i in np.flatnonzero(side & 1):
            apart = root[others] != root[i]
            if side[i] == 3:
                apart[: np.searchsorted(others, i, "right")] = False
            least, most = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
            apart &= part * least >= whole * most
            if not apart.any():
                continue
            seen[flat[begin[i] : begin[i] + size[i]]] = 1
            few = np.flatnonzero(apart)
            if len(few) * 4 < len(others):
                both = np.array([seen[taken[at[j] : at[j + 1]]].sum() for j in few])
            else:
                sums = np.concatenate([[0], np.cumsum(seen[taken])])
                both = (sums[at[1:]] - sums[at[:-1]])[few]
            seen[flat[begin[i] : begin[i] + size[i]]] = 0
            joint = size[others][few] + size[i] - both
            for j in others[few[part * both >= whole * joint]]:
                if root[j] != root[i]:
                    out.append((int(node[i]), int(node[j])))
                    root[root == root[j]] = root[i]
        return out


def _compare(cells: DataFrame, sets: DataFrame, part: float, whole: float) -> DataFrame:
    """``a, b``: the links of ``cells(cell, side, node)``."""
    rows = cells.join(sets, "node").select("cell", "side", "node", "hashes")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Cells | None = None
        for batch in batches:
            if not len(batch):
                continue
            now = _Cells.of(batch, held)
            # the last cell may go on in the next batch
            last = int(np.searchsorted(now.columns[0], now.columns[0][-1]))
            found, held = now.rows(0, last).links(part, whole), now.rows(last, len(now.size))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held is not None:
            found = held.links(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with the number of blocks of their ``by``, and the block that each is dealt to."""
    many = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_HASHES)).cast("int").alias("blocks")
    return rows.join(rows.groupBy(by).agg(many), by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _units(members: DataFrame) -> DataFrame:
    """``unit, node``: what is compared of ``members(key, node)``, a key or a connected group of keys."""
    shipped = lambda n: F.col(n) * F.ceil(F.col(n) / BLOCK_SETS)
    keys = members.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    edges = members.join(keys.select("key", "a"), "key").select("a", F.col("node").alias("b"))
    groups = _shared.cut(_shared.components(edges))
    of_key = keys.join(groups, F.col("a") == F.col("node")).select("key", "component", shipped("n").alias("cost"))
    whole = groups.groupBy("component").agg(F.count("*").alias("m")).select("component", shipped("m").alias("whole"))
    cost = of_key.groupBy("component").agg(F.sum("cost").alias("cost")).join(whole, "component")
    unit = F.when(F.col("whole") <= F.col("cost"), F.xxhash64(F.lit("group"), "component")).otherwise(F.xxhash64(F.lit("key"), "key"))
    named = of_key.drop("cost").join(cost, "component").select("key", unit.alias("unit"))
    return members.join(named, "key").select("unit", "node").distinct()


def linked(nodes: DataFrame | int, members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], part: int, whole: int) -> DataFrame:
    """``(node, component)`` of every node that is linked to another.

    ``nodes`` has ``node`` and ``size`` (of its set), or is the size that none exceeds; ``members`` has ``key`` and ``node`` of
    keys with several nodes, by :func:`members` or :func:`members_of`; two sets with a key in common are linked where ``part * intersection >= whole * union``. ``sets_of(few)``
    gives ``node`` and ``hashes`` (its set, as sorted distinct little-endian 64-bit integers) for the
    nodes of a DataFrame ``few``. The component is named by its least node.
    """
    sized = lambda rows: rows.withColumn("size", F.lit(nodes)) if isinstance(nodes, int) else rows.join(nodes.select("node", "size"), "node")
    units = _shared.cut(_blocks(sized(_units(_shared.cut(members))), "unit"))
    # block i meets block j >= i in the cell (i, j)
    cells = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2)
    cells = cells.select(F.xxhash64("unit", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), side.alias("side"), "node")
    return _shared.components(_compare(cells, sets_of(units.select("node")), part, whole))
