"""Rows that come nearly in order, counted by bin and given out in order.

Each key (a chromosome, a user) has a buffer of the bins that may still grow. A bin leaves it once a
row has come that lies more than ``reach`` beyond it, and the bins of a key leave in order; so the
buffer holds bins of one reach, however long the stream. A row before what has left is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "frontier long, last long, count long, bins binary, counts binary"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_with_state(spark: SparkSession) -> SparkSession:
    """A session of its own, on the same context, whose streams may keep state of this kind."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


class Buffer:
    """The bins of one key: ``bins`` and ``counts`` of those that may still grow, in order, and the last that left.

    The last that left stays open (``count`` > 0) until another leaves, as rows may still come to it.
    """

    def __init__(self, frontier=None, last=None, count=0, bins=b"", counts=b""):
        self.frontier, self.last, self.count = frontier, last, count
        self.bins, self.counts = np.frombuffer(bins, np.int64), np.frombuffer(counts, np.int64)

    def state(self) -> tuple:
        return self.frontier, self.last, self.count, self.bins.tobytes(), self.counts.tobytes()

    def add(self, bins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes rows in; gives back those that are late."""
        late = np.zeros(len(bins), bool) if self.last is None else (bins < self.last if self.count else bins <= self.last)
        fresh = ~late
        if fresh.any():
            both, of = np.unique(np.concatenate([self.bins, bins[fresh]]), return_inverse=True)
            self.counts = np.bincount(of, np.concatenate([self.counts, counts[fresh]]), len(both)).astype(np.int64)
            self.bins = both
            self.frontier = int(max(both[-1], both[-1] if self.frontier is None else self.frontier))
        return bins[late], counts[late]

    def leave(self, reach: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The bins that are complete, in order; all of them where ``reach`` is None."""
        n = len(self.bins) if reach is None else int(np.searchsorted(self.bins, self.frontier - reach)) if self.frontier is not None else 0
        bins, counts = self.bins[:n], self.counts[:n]
        self.bins, self.counts = self.bins[n:], self.counts[n:]
        if self.count and n and bins[0] == self.last:
            counts = np.append(counts[0] + self.count, counts[1:])
        elif self.count and (n or reach is None):
            bins, counts = np.append(self.last, bins), np.append(self.count, counts)
        if not len(bins):
            return bins, counts
        self.last, self.count = int(bins[-1]), 0 if reach is None else int(counts[-1])
        return (bins, counts) if reach is None else (bins[:-1], counts[:-1])


class _Reorder(StatefulProcessor):
    def __init__(self, names: list[str], at: str, reach: int, late: str, idle: int | None):
        self.names, self.at, self.reach, self.late, self.idle = names, at, reach, late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("buffer", STATE)

    def _rows(self, key, bins, counts, late) -> pd.DataFrame:
        out = pd.DataFrame({self.at: bins, "count": counts, "late": late})
        for k, (name, value) in enumerate(zip(self.names, key, strict=True)):
            out.insert(k, name, [value] * len(out))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer = Buffer(*self.held.get()) if self.held.exists() else Buffer()
        behind: list[tuple[np.ndarray, np.ndarray]] = []
        for pdf in rows:
            late = buffer.add(*np.unique(pdf[self.at].to_numpy(np.int64), return_counts=True))
            if len(late[0]):
                if self.late == "error":
                    raise ValueError(f"a row of {key} at {int(late[0][0])} comes after {buffer.last} is done; give a longer reach")
                behind.append(late)
        bins, counts = buffer.leave(self.reach)
        self.held.update(buffer.state())
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if len(bins):
            yield self._rows(key, bins, counts, False)
        for late in behind:
            yield self._rows(key, *late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer = Buffer(*self.held.get())
        bins, counts = buffer.leave(None)
        self.held.update(buffer.state())
        if len(bins):
            yield self._rows(key, bins, counts, False)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: list[str], at: str, reach: int, late: str = "error", idle: int | None = None) -> DataFrame:
    """``keys, at, count, late``: how many rows of each key have each value of ``at``, once no more may come; in order of ``at`` by key.

    ``at`` is a whole number, such as a bin. A value is done when a row more than ``reach`` beyond it
    has come and a later value is done or, with ``idle``, when its key has had no rows for so many
    milliseconds. A row before the last value done (at it, once the key was idle) is late: an error,
    or with ``late="mark"`` a row of its own with ``late`` true and the number of such rows. Rows of
    one micro-batch count as one arrival, so they may lie in any order.

    Rows with a null ``at`` are left out; null keys are keys. For append mode, in a session that
    keeps state in RocksDB (:func:`session_with_state`).
    """
    if late not in ("error", "mark"):
        raise ValueError("late rows are an error or are marked")
    kinds = dict(stream.dtypes)
    fields = "".join(f"{k} {kinds[k]}, " for k in keys) + f"{at} long, count long, late boolean"
    rows = stream.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias(at))
    return rows.groupBy(*keys).transformWithStateInPandas(_Reorder(keys, at, reach, late, idle), fields, "Append", "None" if idle is None else "ProcessingTime")


def reach_of_bins(bin_size: int, max_width: int) -> int:
    """How many bins apart two rows can be when intervals of up to ``max_width`` come by their starts: what covers a bin begins less than a bin and a width before its end."""
    return -(-(bin_size + max_width) // bin_size)
