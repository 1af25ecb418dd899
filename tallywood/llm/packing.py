"""Best-fit packing of tokenised documents into sequences of bounded length.

The plan is made over the histogram of piece lengths, so its cost depends on the sequence length and
not on the number of documents; pieces then take the planned slots by joining on their rank within
their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.llm import _shared

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words that each cache of a worker holds in each of its two generations.
CACHE_WORDS = 250_000
#: Pieces of one length that one task ranks.
RANKED_TOGETHER = 100_000


class _Cache(dict):
    """What ``make`` gives for a key, kept while the key is asked for; at most two generations of CACHE_WORDS."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordTokenizer:
    """Token ids of whole texts, word by word, for tokenizers whose tokens never span white space.

    Texts of Latin characters that no normal form changes are cut by the tokenizer's own pattern, and
    each part goes through its model; other words go through the whole tokenizer. Parts and words
    that were seen lately come from bounded caches.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        bytes_kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.as_char = {b: chr(b) if b in bytes_kept else chr(next(other)) for b in range(256)}
        # the tokenizer's pattern for lower-case text of the characters of ``plain``
        letters, digits = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+")
        self.plain = re.compile(r"[\t\n\r -~¡-ÿ]*")
        self.part_ids, self.word_ids = _Cache(self._part), _Cache(self._word)

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() else "".join(map(self.as_char.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.plain.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.part_ids.__getitem__, self.parts.findall(text.lower())))
        return b"".join(self.ids(w) if self.plain.fullmatch(w) and "<|" not in w else self.word_ids[w] for w in re.split("[ \n]", text))


def cut_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece: its document, number, start, length and the crc32 of its ids.

    A document's ids are its text's, then id 0; only a document of more than ``limit`` ids is cut.
    A null or empty text is the one id 0. A row of ``docs`` that occurs twice gives its pieces
    twice. ``keep_ids`` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size = WordTokenizer(tokenizer), 4 * limit
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            columns = [pa.array([x.as_py() for x in rows[0]], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(rows[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, first rank, end rank, first sequence, per sequence, offset)``.

    Piece ``r`` of a length, ``first <= r < end``, goes to sequence ``first sequence + (r - first) //
    per`` at ``offset + ((r - first) % per) * length``. Sequences that are filled alike stay one
    group, so the work depends on the lengths that occur and not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left: (first sequence, how many)
    levels = np.zeros(limit + 1, np.int64)  # groups at each space left
    out, sequences = [], 0

    def put(space: int, first: int, many: int) -> None:
        if many and space:
            room.setdefault(space, []).append((first, many))
            levels[space] += 1

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero(levels[length:])
            if len(fits):
                space = length + int(fits[0])
                first, many = room[space].pop()
                levels[space] -= 1
            else:
                space, first, many = limit, sequences, -(-left // (limit // length))
                sequences += many
            per = space // length
            whole, rest = min(many, left // per), 0
            if whole < many:
                rest = min(left - whole * per, per)
            if whole:
                out.append((length, rank, rank + whole * per, first, per, limit - space))
                put(space - per * length, first, whole)
            if rest:
                out.append((length, rank + whole * per, rank + whole * per + rest, first + whole, per, limit - space))
                put(space - rest * length, first + whole, 1)
            put(space if space < limit else 0, first + whole + (rest > 0), many - whole - (rest > 0))
            rank += whole * per + rest
            left -= whole * per + rest
    return out


def pack(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece in one sequence, gapless from 0.

    Needs ``doc_id``, ``piece`` and ``length`` (1 to ``limit``); other columns are kept. Equal
    lengths are ranked by id and piece, ties in any order. No pieces give no rows.
    """
    pieces = _shared.cut(pieces)
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``limit`` rows
    rows = plan(histogram, limit)
    # ranks within a length: a common length is dealt to several tasks, each after the ranks of the one before
    parts = max(1, -(-sum(histogram.values()) // RANKED_TOGETHER))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = before.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    # slots of a length are looked up by blocks of ranks, so that a piece meets a few of them
    width = {length: max(1, -(-n // 32)) for length, n in histogram.items()}
    cut = [(length, b, r0, r1, first, per, at, width[length]) for length, r0, r1, first, per, at in rows for b in range(r0 // width[length], (r1 - 1) // width[length] + 1)]
    slots = spark.createDataFrame(cut, "length long, _block long, _r0 long, _r1 long, _first long, _per long, _at long, _width long")
    widths = F.broadcast(spark.createDataFrame(list(width.items()), "length long, _w long"))
    ranked = ranked.join(widths, "length").withColumn("_block", F.expr("_rank div _w"))
    # at most limit lengths x (their groups + 32 blocks) rows whatever the number of documents
    placed = ranked.join(F.broadcast(slots), ["length", "_block"]).where("_rank >= _r0 and _rank < _r1")
    placed = placed.withColumn("sequence_id", F.expr("_first + (_rank - _r0) div _per")).withColumn("offset", F.expr("_at + ((_rank - _r0) % _per) * length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """Pieces of ``docs`` and their places; see :func:`cut_pieces` and :func:`pack`."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut_pieces(docs, tokenizer, limit), limit)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_shared.table(spark, sf_dir, "documents"))
