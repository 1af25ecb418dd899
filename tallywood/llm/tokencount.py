"""Token counts of whole texts by a sentence-piece model, without shuffling their pre-tokens.

No piece of such a model goes on after white space, so a text is cut before every run of blanks and
around every run of line feeds, and its count is the sum of what the cuts (pre-tokens) have alone.
Their counts come from two tiers inside the task that reads the text: a compact hash table of the
most frequent pre-tokens, broadcast with a fixed number of entries, looked up for a whole batch at
once; and, for what it has not, a bounded cache of the worker in front of the model.

Which pre-tokens are frequent is counted over all documents: every task keeps a summary of fixed
size (Misra-Gries: counts fall by what is pushed out), and the summaries are added up by Spark. The
table decides how fast a count is found, never what it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.llm import _shared
from tallywood.llm._words import U, mix, spans, texts_of

#: Entries of the broadcast table, and of a task's summary: 17 bytes an entry and 4 for each of twice as many slots.
FREQUENT = 1 << 15
#: Bytes of the longest pre-token that the table can hold; longer ones go to the second tier.
PACKED = 16
#: Pre-tokens in each of the two generations of a worker's cache, and bytes of the longest of them.
CACHED, CACHED_BYTES = 200_000, 64
#: Buckets of pre-tokens in each of which the most frequent are looked for.
BUCKETS = 1024
SPACE, FEED = 32, 10
#: What the cuts are tried on before a model is used.
PROBE = "A  probe\n\n of cuts\t, café ﬁ Å 　x y ▁z <s> 日本語\n line  "
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_workers: dict[str, "Encoder"] = {}


class Encoder:
    """The second tier: counts of single pre-tokens, from a cache of two generations or the model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.base = len(self.model.encode("\n"))
        self.new: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def fits(self) -> bool:
        """Whether cutting is exact: no piece crosses a cut, text is not rewritten, and a probe agrees."""
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]
        whole = all("▁" not in p.lstrip("▁") and ("\n" not in p or p == "\n") for p in pieces)
        same = m.normalize(PROBE) == "▁" + PROBE.replace(" ", "▁")
        return whole and same and int(counts(pa.array([PROBE]), None, self)[0]) == len(m.encode(PROBE))

    def encoded(self, parts: list[bytes]) -> list[int]:
        """Counts of pre-tokens by the model; behind a line feed, which joins with nothing, no blank is added in front."""
        found = self.model.encode(["\n" + p.decode() for p in parts], num_threads=1)
        return [len(x) - self.base for x in found]

    def counts(self, parts: list[bytes]) -> np.ndarray:
        new, old = self.new, self.old
        missing = []
        for p in dict.fromkeys(parts):
            if p not in new:
                if p in old:
                    new[p] = old[p]
                else:
                    missing.append(p)
        here = dict(zip(missing, self.encoded(missing), strict=True)) if missing else {}
        long = {p: n for p, n in here.items() if len(p) > CACHED_BYTES}
        new.update(here)
        out = np.fromiter(map(new.__getitem__, parts), np.int64, len(parts))
        for p in long:
            del new[p]
        if len(new) >= CACHED:
            self.old, self.new = new, {}
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a model: the cache lives as long as the worker."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


class Table:
    """The first tier: open addressing over pre-tokens of up to PACKED bytes, each held whole as two 64-bit numbers and its size."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, tokens: np.ndarray):
        self.low, self.high, self.size, self.tokens = low, high, size.astype(np.uint8), tokens.astype(np.uint8)
        self.mask = U((1 << max(1, (2 * len(low)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        at, left = hashed(low, high, size) & self.mask, np.arange(len(low), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + U(1)) & self.mask, left[lost]

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Counts of tokens, -1 for what the table has not."""
        out = np.full(len(low), -1, np.int64)
        at, left = hashed(low, high, size) & self.mask, np.flatnonzero(size <= PACKED)
        at = at[left]
        while len(left):
            entry = self.slots[at]
            some = entry >= 0
            at, left, entry = at[some], left[some], entry[some]
            same = (self.low[entry] == low[left]) & (self.high[entry] == high[left]) & (self.size[entry] == size[left])
            out[left[same]] = self.tokens[entry[same]]
            at, left = (at[~same] + U(1)) & self.mask, left[~same]
        return out


def hashed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(low ^ mix(high + size.astype(U)))


def cuts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, a blank before each that isn't empty; where pre-tokens start, with the end of all; the row of each."""
    texts = pc.replace_substring(texts.cast(pa.large_string()), "▁", " ")
    nothing, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    data, off = texts_of(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(nothing, texts, blank)))
    x, at = data[off[0] : off[-1]], off - off[0]
    kind = (x == SPACE) + 2 * (x == FEED).astype(np.uint8)
    start = np.zeros(len(x), bool)
    start[at[:-1][np.diff(at) > 0]] = True
    start[1:] |= (kind[1:] != kind[:-1]) & ((kind[1:] != 0) | (kind[:-1] == 2))
    starts = np.flatnonzero(start)
    return x, np.append(starts, len(x)), np.searchsorted(at, starts, "right") - 1


def packed(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first PACKED bytes of each pre-token as two numbers, and its size."""
    padded = np.concatenate([x, np.zeros(PACKED, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at, size = edges[:-1], np.diff(edges)
    return eight[at] & _MASKS[np.minimum(size, 8)], eight[at + 8] & _MASKS[np.clip(size - 8, 0, 8)], size


def counts(texts: pa.Array, table: Table | None, behind: Encoder) -> np.ndarray:
    """Tokens of each text; no null."""
    x, edges, row = cuts(texts)
    low, high, size = packed(x, edges)
    found = table.find(low, high, size) if table else np.full(len(row), -1, np.int64)
    missing = np.flatnonzero(found < 0)
    if len(missing):
        raw = x.tobytes()
        found[missing] = behind.counts([raw[a:b] for a, b in zip(edges[missing].tolist(), edges[missing + 1].tolist(), strict=True)])
    return np.bincount(row, found, len(texts)).astype(np.int64)


def merged(parts: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Summaries ``(low, high, size, n)`` added up and cut to ``most`` entries, each less what the first of the rest has."""
    low, high, size, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    _, first, of = np.unique(hashed(low, high, size), return_index=True, return_inverse=True)
    n = np.bincount(of, n, len(first)).astype(np.int64)
    if len(first) > most:
        top = np.argpartition(n, len(n) - most - 1)
        n = n - n[top[len(n) - most - 1]]
        keep = np.flatnonzero(n > 0)
        first, n = first[keep], n[keep]
    return low[first], high[first], size[first], n


def frequent(docs: DataFrame, text_col: str = "text", entries: int = FREQUENT) -> list[bytes]:
    """The pre-tokens most frequent in all texts, as each task's summary of ``entries`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            texts = batch.column(0).cast(pa.large_string()).fill_null("")
            for lo, hi in spans(texts_of(texts)[1], 1 << 22):
                x, edges, _ = cuts(texts[lo:hi])
                low, high, size = packed(x, edges)
                short = size <= PACKED
                one = low[short], high[short], size[short], np.ones(short.sum(), np.int64)
                kept = merged([one] if kept is None else [kept, merged([one], 8 * entries)], entries)
        if kept is not None:
            low, high, size, n = kept
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(size, pa.int32()), pa.array(n)], ["low", "high", "size", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "low long, high long, size int, n long")
    each = Window.partitionBy(F.pmod(F.xxhash64("low", "high", "size"), F.lit(BUCKETS))).orderBy(F.desc("n"), "low", "high", "size")
    added = rows.groupBy("low", "high", "size").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(each))
    # several times a bucket's share of the most frequent, so that few rows are left to be sorted together
    top = added.where(F.col("rank") <= max(8, 8 * entries // BUCKETS)).orderBy(F.desc("n"), "low", "high", "size").limit(entries)
    return [(r.low % (1 << 64) | r.high % (1 << 64) << 64).to_bytes(PACKED, "little")[: r.size] for r in top.collect()]  # ``entries`` rows at most


def table_of(parts: list[bytes], behind: Encoder) -> Table:
    """The broadcast table; a pre-token of over 255 tokens can't be in it."""
    x = np.frombuffer(b"".join(parts), np.uint8)
    return Table(*packed(x, np.cumsum([0, *map(len, parts)])), np.array(behind.encoded(parts), np.int64))


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", entries: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``n_tokens`` is what the sentence-piece ``model`` (a path that all workers see) gives for the
    whole text, without begin and end. A null or empty text has none. A row that occurs twice is
    counted twice; ids may be null; other columns, whatever their names, are left out; an empty
    table gives no rows. A very long text is one row of its batch and is looked up like others; a
    very long pre-token goes to the model whole. A model whose pieces cross white space, or that
    rewrites text, is an error.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    own = encoder(model)
    if not own.fits():
        raise ValueError(f"texts can't be cut at white space for {model}")
    known = frequent(docs, text_col, entries)
    table = docs.sparkSession.sparkContext.broadcast(table_of(known, own) if known else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind = encoder(model)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            size = pc.binary_length(texts).cast(pa.int64())
            found = [counts(texts[lo:hi], table.value, behind) for lo, hi in spans(texts_of(texts)[1], 1 << 22)]
            n = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_shared.table(spark, sf_dir, "documents"))
