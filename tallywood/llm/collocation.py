"""Phrases whose words stand together more often than their parts would by chance.

Every task counts by suffix automata: it gathers the pieces of its texts by language, and once they
make a shard, builds their generalised suffix automaton down to substrings of a few words. A state
is a set of end places; its number of places is the count of each of its substrings, of which it
holds those longer than the ones of its suffix link. Spark adds up the counts of all shards.

A phrase is never more frequent than its parts, so words are counted first, then phrases of two
words, and so on, and a shard counts a phrase only where what it is without its first and without
its last word may be frequent: that says a Bloom filter of fixed largest size, which lets all
frequent ones pass. Filters save rows to be added up and never decide.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.llm import _shared
from tallywood.llm._words import U, mix, spans, texts_of

#: What ends a piece; blanks and tabs part words.
ENDS = b".,;:!?\n\x0b\x0c\r"
_CUT = bytes(10 if c in ENDS else c for c in range(256))
#: Words of all languages that a task gathers before it counts them, bytes of text read and phrases written at once.
SHARD, TOGETHER, JOINED = 1 << 19, 1 << 20, 1 << 16
#: Bits a frequent phrase has in a filter, most bits of a filter (16 MB), probes, and bits of a block that one row of it holds.
BITS, MOST_BITS, PROBES, BLOCK = 16, 1 << 27, 4, 1 << 15
#: Buckets of a language's phrases in each of which the best are looked for, before the best of all.
BUCKETS = 256
COUNTS = "lang string, phrase string, n long"


class Automaton:
    """The suffix automaton of ``words`` (numbers from 1, 0 between pieces) for substrings of up to ``depth`` words.

    It is laid out by sorting: end places in order of the words before them, last word first, bring
    the places of each substring together, and what goes on alike to the left everywhere is one
    state. ``shortest`` and ``longest`` are the sizes of a state's substrings, ``places`` their count,
    ``row`` a line of ``before``, which has the words in front of an end place, last word first, and
    ``link`` the state of what is one word shorter than the shortest (-1: the empty one). Where
    ``ends`` is false, a word is in front of others and no end place itself.
    """

    def __init__(self, words: np.ndarray, depth: int, ends: np.ndarray | None = None):
        bits = 63 // depth
        if len(words) and int(words.max()) >> bits:
            raise ValueError("too many different words for one shard")
        line = np.concatenate([np.zeros(depth - 1, np.int64), words])
        back, open_ = [words], words > 0
        for d in range(1, depth):
            before = np.where(open_, line[depth - 1 - d : len(line) - d], 0)
            back.append(before)
            open_ = before > 0
        key = np.zeros(len(words), np.int64)
        for column in back:
            key = key << bits | column
        key = np.sort(key[words > 0 if ends is None else (words > 0) & ends])
        n, at = len(key), np.arange(len(key))
        self.before = np.stack([key >> bits * (depth - 1 - d) & (1 << bits) - 1 for d in range(depth)], 1)
        # places of the substring of d words that begins at a row, 0 where none begins there; rows of shorter contexts come first
        many = np.zeros((depth + 2, n), np.int64)
        first = []
        for d in range(1, depth + 1):
            part = key >> bits * (depth - d)
            new = np.ones(n, bool)
            new[1:] = part[1:] != part[:-1]
            begin = np.flatnonzero(new)
            many[d, begin] = np.diff(np.append(begin, n))
            many[d, self.before[:, d - 1] == 0] = 0
            first.append(np.maximum.accumulate(np.where(new, at, 0)) if n else at)
        tops = [np.flatnonzero((many[d] > 0) & (many[d + 1] != many[d])) for d in range(1, depth + 1)]
        self.longest = np.repeat(np.arange(1, depth + 1), [len(t) for t in tops])
        self.row = np.concatenate(tops)
        self.places = many[self.longest, self.row]
        self.shortest = self.longest.copy()
        state = np.full((depth + 1, n), -1, np.int64)
        state[self.longest, self.row] = np.arange(len(self.row))
        for _ in range(depth - 1):
            more = np.flatnonzero((self.shortest > 1) & (many[self.shortest - 1, self.row] == self.places))
            self.shortest[more] -= 1
            state[self.shortest[more], self.row[more]] = more
        self.link = np.full(len(self.row), -1, np.int64)
        for d in range(2, depth + 1):
            of = np.flatnonzero(self.shortest == d)
            self.link[of] = state[d - 1, first[d - 2][self.row[of]]]

    def substrings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The different substrings of ``size`` words, a row each in reading order, and their counts."""
        of = np.flatnonzero((self.shortest <= size) & (size <= self.longest))
        return self.before[self.row[of], :size][:, ::-1], self.places[of]


class _Filter:
    """A Bloom filter of phrases by language, by the hashes of their words."""

    def __init__(self, blocks: dict[int, bytes], bits: int):
        self.bits = np.zeros(bits // 8, np.uint8)
        for k, block in blocks.items():
            self.bits[k * BLOCK // 8 : (k + 1) * BLOCK // 8] = np.frombuffer(block, np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in probes(hashes, 8 * len(self.bits)):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = mix(hashes) | U(1)
    for k in range(PROBES):
        yield ((hashes + U(k) * step) & U(bits - 1)).astype(np.int64)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode())
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), U, len(words))


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one more word each."""
    return mix(hashes * U(0xD6E8FEB86659FD93) + words)


def frequent(phrases: DataFrame) -> _Filter:
    """The filter of ``phrases(lang, phrase)``; it has BITS bits a row up to MOST_BITS in all, and more rows only let more pass."""
    n = _shared.count(phrases)
    bits = min(MOST_BITS, max(BLOCK, 1 << (BITS * n).bit_length()))

    def at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.zeros(len(batch), U)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = word_hashes(lang, phrase.encode().split(b" "))
                hashes[i : i + 1] = reduce(longer, (own[k : k + 1] for k in range(len(own))))
            places = np.concatenate(list(probes(hashes, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(places // BLOCK, pa.int32()), pa.array(places % BLOCK, pa.int32())], ["block", "bit"])

    def joined(key, rows):
        import pandas as pd

        block = np.zeros(BLOCK, np.uint8)
        block[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(block, bitorder="little").tobytes()]})

    set_ = phrases.select("lang", "phrase").mapInArrow(at, "block int, bit int").distinct()
    rows = set_.groupBy("block").applyInPandas(joined, "block int, bits binary").collect()  # MOST_BITS at most
    return _Filter({r.block: bytes(r.bits) for r in rows}, bits)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Of some texts of one language: their words, and the number of the piece of each."""
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).fill_null(b"")
        for lo, hi in spans(texts_of(batch.column(1))[1], TOGETHER):
            own = langs[lo:hi]
            for lang in own.unique():
                whole = b"\n".join(texts[lo:hi].filter(pc.equal(own, lang)).to_pylist()).lower().translate(_CUT)
                at = 0
                while at < len(whole):  # a longer text in parts that end with a piece
                    end = whole.find(b"\n", at + TOGETHER)
                    text, at = (whole[at:end], end + 1) if end >= 0 else (whole[at:], len(whole))
                    x = np.frombuffer(text, np.uint8)
                    blank = (x == 32) | (x == 9) | (x == 10)
                    begin = ~blank
                    begin[1:] &= blank[:-1]
                    yield lang.as_py(), text.split(), np.cumsum(x == 10)[begin]


def _rows(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(n), JOINED):
        part = phrases[lo : lo + JOINED].cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), part, pa.array(n[lo : lo + JOINED], pa.int64())], ["lang", "phrase", "n"])


def word_counts(own: DataFrame) -> DataFrame:
    """``lang, phrase, n`` of every word of ``own(lang, text)``, and of all words together with a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        total: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                yield from _rows(lang, pa.array(list(found), pa.binary()), np.fromiter(found.values(), np.int64, len(found)))
            held.clear()

        for lang, words, _ in _read(batches):
            held[lang].update(words)
            total[lang] += len(words)
            if sum(map(len, held.values())) >= SHARD:
                yield from flush()
        yield from flush()
        for lang, n in total.items():
            yield from _rows(lang, pa.array([None], pa.string()), np.array([n]))

    return own.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


class _Shard:
    """Words of one language as numbers, with the pieces they stand in, until they are counted."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)
        self.words: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def add(self, words: list[bytes], piece: np.ndarray, shared: int) -> None:
        """``words``, of which the first ``shared`` end no phrase here: the part before has them."""
        at = np.arange(len(words)) + piece - piece[0] + 1  # a 0 before every piece
        line, end = np.zeros(at[-1] + 1, np.int32), np.zeros(at[-1] + 1, bool)
        line[at] = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        line[at] += 1
        end[at[shared:]] = True
        self.words.append(line)
        self.ends.append(end)

    def phrases(self, lang: str, size: int, filters: list[_Filter]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """The phrases of ``size`` words whose parts of 1, 2, ... words pass the filters, and their counts."""
        words, known = np.concatenate(self.words).astype(np.int64), list(self.known)
        hashes = np.append(U(0), word_hashes(lang, known))
        passes, hashes = np.append(False, filters[0].passes(hashes[1:]))[words], hashes[words]
        phrase = hashes
        for n in range(2, size + 1):
            # a phrase may be frequent where what it is without its first word and without its last are
            passes[1:] &= passes[:-1].copy()
            passes[0] = False
            if n < size:
                phrase = longer(np.append(U(0), phrase[:-1]), hashes)
                at = np.flatnonzero(passes)
                passes[at] = filters[n - 1].passes(phrase[at])
        automaton, texts = Automaton(words, size, passes & np.concatenate(self.ends)), pa.array(known, pa.binary())
        rows, n = automaton.substrings(size)
        for lo in range(0, len(n), JOINED):
            yield _joined(texts, rows[lo : lo + JOINED]), n[lo : lo + JOINED]


def _joined(texts: pa.Array, rows: np.ndarray) -> pa.Array:
    """Phrases of the words that stand at the numbers (from 1) of each row."""
    return pc.binary_join_element_wise(*(texts.take(pa.array(rows[:, k] - 1)) for k in range(rows.shape[1])), b" ")


def phrase_counts(own: DataFrame, size: int, filters: list) -> DataFrame:
    """``lang, phrase, n`` of the phrases of ``size`` words whose shorter parts the filters (broadcasts, for 1 word and on) let pass."""
    most = min(SHARD, (1 << 63 // size) - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Shard] = defaultdict(_Shard)
        full = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, shard in held.items():
                for phrases, n in shard.phrases(lang, size, [f.value for f in filters]):
                    yield from _rows(lang, phrases, n)
            held.clear()

        for lang, words, piece in _read(batches):
            # what is longer than a shard, as a very long text may be, goes in parts; each begins with the words on which its phrases may begin
            step = most - size
            for lo in range(0, len(words), step):
                at = max(lo - size + 1, 0)
                part = words[at : lo + step]
                if full + len(part) > most:
                    yield from flush()
                    full = 0
                held[lang].add(part, piece[at : lo + step], lo - at)
                full += len(part)
        yield from flush()

    return own.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score.

    Texts, with A-Z lower-cased, are split into pieces at ``.,;:!?`` and line ends, pieces into words
    at blanks and tabs. A candidate is a phrase of 2 to ``longest`` words that occurs ``least`` times
    or more in pieces of its language (``a`` times); of its cuts in two, with ``l`` and ``r``
    occurrences, that of the least score floor(1000000 a a / (l r)) counts, the earliest of several.
    A candidate inside a longer one that occurs at least ``percent`` in 100 times as often is left
    out, whether or not the longer one is. ``n`` is the number of words of the language. Phrases of
    equal score come by ``a``, then by their bytes. Products are exact while counts are under 10^16.

    A null text has no words, a null language is ``und``. A row that occurs twice counts twice.
    Other columns, whatever their names, are not looked at; an empty table gives no rows.
    """
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = _shared.written(word_counts(own).where(F.col("phrase").isNull() | (F.col("n") >= least)))
    totals = words.where("phrase is null").select("lang", F.col("n").alias("total"))
    words = words.where("phrase is not null")
    levels, filters = [words], []
    for size in range(2, longest + 1):
        filters.append(own.sparkSession.sparkContext.broadcast(frequent(levels[-1])))
        levels.append(_shared.written(phrase_counts(own, size, filters).where(F.col("n") >= least)))
    known = reduce(DataFrame.unionByName, levels)
    phrases = reduce(DataFrame.unionByName, levels[1:])

    parts = phrases.withColumn("w", F.split("phrase", " ", -1))
    cuts = parts.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _phrase(F.slice("w", F.lit(1), F.col("k"))).alias("first"), _phrase(F.slice("w", F.col("k") + 1, F.size("w"))).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a"))).alias("over"), (wide("l") * wide("r")).alias("under"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # the suffix link of a phrase leaves out its first word, that of its prefix the last as well: together they reach all phrases inside it
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = parts.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("more"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("more").isNull() | (F.col("more") * 100 < F.col("a") * percent))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).orderBy(*order)
    best = left.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)  # BUCKETS * top at most meet in the next step
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_shared.table(spark, sf_dir, "documents"))
