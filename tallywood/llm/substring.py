"""Passages that repeat across documents: MinHash banding of paragraphs, exact checks, components.

A paragraph is a stretch of words cut out by its content, wherever lines break: a word whose hash is
the least among its neighbours' begins one, so the paragraphs inside a passage are the same in every
document that has it. Paragraphs that agree in a band of MinHash values are compared by their whole
sets of word shingles and joined into components. A document's neighbouring paragraphs whose
components an earlier document has, at one distance, are aligned with that document word by word, edits
included, as far as both go on alike; what is long enough is a passage, and the earlier place stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.llm import _link, _shared
from tallywood.llm._words import NONSPACE, U, Words, _power_tables, mix, shingles_at, spans, texts_of, words_of
from tallywood.llm.neardup import distinct_sets, signatures

#: A paragraph begins where a word's hash is the least of so many to each side; the most words of one.
REACH, MOST = 4, 30
#: Values in a band, and pairs of exactly the least similarity that may agree in no band.
ROWS, MISSED = 2, 0.01
#: Words of the shortest passage.
LEAST = 50
#: Words around paragraphs that the alignment may go on into, and between two that it may bridge.
AROUND = 48
#: Up to so many ids of texts are sent to all tasks.
MOST_NAMED = 1 << 21
#: Different paragraphs whose keys a task remembers, so that a common one gives its keys once and not each time.
REMEMBERED = 200_000


def bands_for(similarity: float, rows: int = ROWS, missed: float = MISSED) -> int:
    """The fewest bands that miss at most ``missed`` of the pairs that are just similar enough."""
    return int(np.ceil(np.log(missed) / np.log(1 - similarity**rows)))


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = signature.shape[1] // rows
    out = np.empty((len(signature), bands), U)
    for b in range(bands):
        key = np.full(len(signature), U(b + 1))
        for k in range(rows):
            key = mix(key * U(0xD6E8FEB86659FD93) + signature[:, b * rows + k].astype(U))
        out[:, b] = key
    return out


def paragraphs(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each paragraph its row, first word and word count; together they cover all words."""
    n, first = len(hashes), words.first
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # pairs of words are less often equal than words; the last word of a row has none
    pair = np.empty(n, U)
    pair[:-1] = mix(hashes[:-1] * U(3) + hashes[1:])
    pair[first[1:][np.diff(first) > 0] - 1] = U((1 << 64) - 1)
    begins = np.ones(n, bool)
    for d in range(1, min(REACH, n - 1) + 1):
        same = row[d:] == row[:-d]
        begins[d:] &= ~same | (pair[d:] < pair[:-d])
        begins[:-d] &= ~same | (pair[:-d] <= pair[d:])
    begins[first[:-1][np.diff(first) > 0]] = True
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, n))
    # a row's last paragraph ends with the row, as the next row's first word begins one
    pieces = -(-size // MOST)
    begin = np.repeat(start, pieces) + MOST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return row[begin], begin, np.diff(np.append(begin, n))


def _sequence(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the words of each stretch, in order."""
    up, down = _power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[begin + n] - sums[begin]) * down[begin] + n.astype(U))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.where("doc_id is not null and text is not null").withColumn("part", F.xxhash64("text"))


def _places(own: DataFrame) -> DataFrame:
    """``doc_id, part, k, at, n, node`` of all paragraphs: number, first word, words, and the name of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for lo, hi in spans(offsets):
                words = words_of(data, offsets[lo : hi + 1], NONSPACE)
                hashes = words.hashes()
                row, begin, n = paragraphs(words, hashes)
                k = np.arange(len(row)) - np.searchsorted(row, row)
                ids = [batch.column(c).take(pa.array(row + lo)) for c in ("doc_id", "part")]
                rest = [pa.array(x.astype(np.int32)) for x in (k, begin - words.first[row], n)]
                yield pa.RecordBatch.from_arrays([*ids, *rest, pa.array(_sequence(hashes, begin, n).view(np.int64))], ["doc_id", "part", "k", "at", "n", "node"])

    return own.mapInArrow(run, "doc_id long, part long, k int, at int, n int, node long")


def _keys(own: DataFrame, width: int, bands: int, buckets: int) -> DataFrame:
    """``bucket, pairs``: the bands of all paragraphs with their nodes, as :func:`_link.dealt` makes them for so many ``buckets``.

    What a task has lately given it doesn't give again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for lo, hi in spans(offsets):
                words = words_of(data, offsets[lo : hi + 1], NONSPACE)
                hashes = words.hashes()
                _, begin, n = paragraphs(words, hashes)
                node, pick = np.unique(_sequence(hashes, begin, n).view(np.int64), return_index=True)
                fresh = np.array([x not in recent for x in node.tolist()], bool)
                node, pick = node[fresh], pick[fresh]
                if len(recent) + len(node) > REMEMBERED:
                    recent.clear()
                recent.update(node.tolist())
                keys = band_keys(signatures(*shingles_at(hashes, begin[pick], n[pick], width), bands * ROWS, 16))
                held.append((keys.ravel(), np.repeat(node, bands)))
                if sum(len(k) for k, _ in held) >= _link.BUCKET:
                    yield from made(held)
                    held = []
        if held:
            yield from made(held)

    def made(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, node = (np.concatenate(x) for x in zip(*held, strict=True))
        for at in range(0, len(key), _link.BUCKET):
            yield _link.dealt(key[at : at + _link.BUCKET], node[at : at + _link.BUCKET], buckets)

    return own.select("text").mapInArrow(run, "bucket int, pairs binary")


def _slices(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, part, lo, hi, words, late``: hashes of the words ``lo`` to ``hi`` (cut off at the ends) of the texts named.

    ``late`` is as ``wanted`` has it, to tell what is wanted for one side of a join from what is for the other.
    """
    wanted = _shared.cut(wanted.groupBy("doc_id", "part").agg(F.collect_set(F.struct("lo", "hi", "late")).alias("ranges")))
    # no text moves but those named, while their ids are few enough for all tasks
    if _shared.count(wanted) <= MOST_NAMED:
        own = own.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = own.join(wanted, ["doc_id", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for lo, hi in spans(offsets):
                words = words_of(data, offsets[lo : hi + 1], NONSPACE)
                hashes = words.hashes().astype("<u8")
                listed = batch.column("ranges").slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), listed.value_lengths().to_numpy(zero_copy_only=False))
                begin, end = (listed.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                late = listed.flatten().field(2)
                a = words.first[row] + np.maximum(begin, 0)
                b = np.minimum(words.first[row] + end, words.first[row + 1])
                ids = [batch.column(c).take(pa.array(row + lo)) for c in ("doc_id", "part")]
                step = 20_000
                for s in range(0, len(row), step):
                    cut = slice(s, s + step)
                    whole = pa.array([hashes[x:y].tobytes() for x, y in zip(a[cut], b[cut], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(x.slice(s, step) for x in ids), pa.array(begin[cut], pa.int32()), pa.array(end[cut], pa.int32()), whole, late.slice(s, step)], ["doc_id", "part", "lo", "hi", "words", "late"])

    return texts.select("doc_id", "part", "text", "ranges").mapInArrow(run, "doc_id long, part long, lo int, hi int, words binary, late boolean")


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How many words of ``a`` and ``b`` go on alike from their beginnings, and the edits between them.

    After a word that differs, up to 3 words of each are passed over where 4 equal words follow (the
    fewest passed over count as edits); the last words are equal ones.
    """
    i = j = edits = 0
    stop = (0, 0, 0)
    while True:
        m = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + m] != b[j : j + m])
        go = int(differ[0]) if len(differ) else m
        i, j = i + go, j + go
        if go:
            stop = (i, j, edits)
        for x, y in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3), (3, 2), (2, 3), (3, 1), (1, 3), (3, 0), (0, 3)):
            if i + x + 4 <= len(a) and j + y + 4 <= len(b) and (a[i + x : i + x + 4] == b[j + y : j + y + 4]).all():
                i, j, edits = i + x, j + y, edits + max(x, y)
                break
        else:
            return stop


def align(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Ranges of ``a`` and ``b`` that are alike around the ``seeds`` (places in both): ``(begin, end, begin, end)``.

    A range has ``least`` words in both and, of its longer side, at least ``percent`` hundredths unedited.
    """
    out, covered = [], -1
    for s, t in seeds:
        if s < covered:
            continue
        right, left = _extend(a[s:], b[t:]), _extend(a[:s][::-1], b[:t][::-1])
        lo, hi, other_lo, other_hi = s - left[0], s + right[0], t - left[1], t + right[1]
        covered = max(covered, hi)
        size = max(hi - lo, other_hi - other_lo)
        if min(hi - lo, other_hi - other_lo) >= least and 100 * (size - left[2] - right[2]) >= percent * size:
            out.append((lo, hi, other_lo, other_hi))
    return out


PASSAGE = "doc_id long, part long, word int, n_words int, first_doc_id long, first_part long, first_word int, first_n_words int, passage long"


def _aligned(pairs: DataFrame, least: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            get = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for r in range(len(batch)):
                lo, first_lo = max(get["lo"][r], 0), max(get["first_lo"][r], 0)
                seeds = [(x - lo, x - get["shift"][r] - first_lo) for x in sorted(get["seeds"][r])]
                for a0, a1, b0, b1 in align(np.frombuffer(get["words"][r], "<u8"), np.frombuffer(get["first_words"][r], "<u8"), seeds, least, percent):
                    rows.append((get["doc_id"][r], get["part"][r], lo + a0, a1 - a0, get["first_doc_id"][r], get["first_part"][r], first_lo + b0, b1 - b0, get["passage"][r]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    return pairs.mapInArrow(run, PASSAGE)


NAMES = [c.split()[0] for c in PASSAGE.split(", ")]
KINDS = [pa.int64() if c.endswith("long") else pa.int32() for c in PASSAGE.split(", ")]


def repeated_passages(docs: DataFrame, width: int = 5, percent: int = 80, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, part, word, n_words, passage, first_doc_id, first_part, first_word, first_n_words, removed`` of passages in two documents.

    A passage has ``least`` or more words, counted from 0 between white space, A-Z counting as a-z; line
    ends are white space. It stands in an earlier document (of smaller id) from ``first_word`` on with
    at most 100 - ``percent`` hundredths of its words edited; of several earlier documents the earliest is
    named, and another may go on alike for a few words more. ``removed`` rows are the later places;
    the others name the places that those are copies of. ``passage`` is the component of the first
    paragraph that both have. Rows of one document may overlap. ``part`` is a hash of the text: rows
    with one id are one document of several texts, equal texts of different ids are compared as one
    text and each copy is a passage of all its words. Null texts, and rows with a null id, have none;
    an empty table gives no rows.
    """
    own = _own(docs, id_col, text_col)
    places = _shared.written(_places(own))
    # copies of a text are one text, of the least id
    ends = places.groupBy("part", "doc_id").agg(F.max(F.col("at") + F.col("n")).alias("n_words"))
    least_id = ends.groupBy("part").agg(F.min("doc_id").alias("first_doc_id"))
    texts = _shared.cut(ends.join(least_id, "part"))
    copies = texts.where("doc_id <> first_doc_id and n_words >= %d" % least)
    zero = F.lit(0).alias
    copies = copies.select("doc_id", "part", zero("word"), "n_words", "first_doc_id", F.col("part").alias("first_part"), zero("first_word"), F.col("n_words").alias("first_n_words"), F.col("part").alias("passage"))

    def sets_of(few: DataFrame) -> DataFrame:
        few = _shared.cut(few.distinct())
        few = F.broadcast(few) if _shared.count(few) <= MOST_NAMED else few
        # one place of each node, found without sorting: the least hash of a place
        name = F.xxhash64("doc_id", "part", "at").alias("name")
        one = _shared.cut(places.join(few, "node", "left_semi").select("node", "doc_id", "part", "at", "n", name))
        one = one.join(one.groupBy("node").agg(F.min("name").alias("name")), ["node", "name"]).dropDuplicates(["node"])
        one = one.select("node", "doc_id", "part", F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi"))
        one = _shared.cut(one)
        got = _slices(own, one.withColumn("late", F.lit(False))).join(one, ["doc_id", "part", "lo", "hi"]).select("node", "words").dropDuplicates(["node"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [np.frombuffer(x, "<u8") for x in batch.column("words").to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                sets, bounds = distinct_sets(*shingles_at(np.concatenate([*words, np.empty(0, U)]).astype(U), np.cumsum(n) - n, n, width))
                whole = [sets[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(whole, pa.binary())], ["node", "hashes"])

        return got.mapInArrow(run, "node long, hashes binary")

    bands = bands_for(percent / 100)
    buckets = min(_shared.count(places) * bands // _link.BUCKET + 1, 1 << 30)
    found = _link.linked(MOST, _link.members_of(_keys(own, width, bands, buckets)), sets_of, 100, percent)
    # the words that two documents have, as they are or alike
    same = places.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("node")
    often = found.toDF("node", "name").union(same.join(found, "node", "left_anti").select("node", F.col("node").alias("name")))
    again = places.join(often, "node").drop("node")
    again = again.join(texts.where("doc_id = first_doc_id").select("doc_id", "part"), ["doc_id", "part"])
    again = _shared.written(again.dropDuplicates(["doc_id", "part", "k"]))
    # a paragraph's earlier place is that of the that of its name, and that of its name and the next one's, which fewer texts have
    along = Window.partitionBy("doc_id", "part").orderBy("k")
    rows = again
    following = F.when(F.lead("k").over(along) == F.col("k") + 1, F.xxhash64("name", F.lead("name").over(along)))
    name_of = [F.col("name"), F.col("following")]
    rows = rows.withColumn("following", following)
    rows = rows.select("doc_id", "part", "at", "n", F.col("name").alias("passage"), F.explode(F.array(*name_of)).alias("name")).where("name is not null")
    place = F.struct("doc_id", "part", "at")
    first = rows.groupBy("name").agg(F.min(place).alias("first"))
    rows = rows.join(first, "name").where("doc_id <> first.doc_id")
    rows = rows.select("doc_id", "part", "at", "n", "passage", F.col("first.doc_id").alias("first_doc_id"), F.col("first.part").alias("first_part"), (F.col("at") - F.col("first.at")).alias("shift")).distinct()
    # what lies at one distance from one text, with few words between, is aligned together
    pair = ["doc_id", "part", "first_doc_id", "first_part", "shift"]
    order = Window.partitionBy(*pair).orderBy("at")
    rows = rows.withColumn("opens", (F.col("at") > F.coalesce(F.lag(F.col("at") + F.col("n")).over(order), F.lit(-(1 << 30))) + AROUND).cast("int"))
    rows = rows.withColumn("stretch", F.sum("opens").over(order))
    lo, hi = F.min("at") - AROUND, F.max(F.col("at") + F.col("n")) + AROUND
    pairs = rows.groupBy(*pair, "stretch").agg(lo.alias("lo"), hi.alias("hi"), F.collect_set("at").alias("seeds"), F.min("passage").alias("passage"))
    pairs = _shared.written(pairs.drop("stretch").withColumn("first_lo", F.col("lo") - F.col("shift")).withColumn("first_hi", F.col("hi") - F.col("shift")))
    earlier = pairs.select(F.col("first_doc_id").alias("doc_id"), F.col("first_part").alias("part"), F.col("first_lo").alias("lo"), F.col("first_hi").alias("hi"))
    # each join moves its own side's slices alone
    wanted = pairs.select("doc_id", "part", "lo", "hi", F.lit(True).alias("late")).union(earlier.withColumn("late", F.lit(False)))
    slices = _shared.written(_slices(own, wanted))
    both = pairs.join(slices.where("late").drop("late"), ["doc_id", "part", "lo", "hi"])
    both = both.join(slices.where("not late").drop("late").toDF("first_doc_id", "first_part", "first_lo", "first_hi", "first_words"), ["first_doc_id", "first_part", "first_lo", "first_hi"])
    later = _shared.cut(_aligned(both, least, percent).union(copies).distinct())
    kept = later.select(F.col("first_doc_id").alias("doc_id"), F.col("first_part").alias("part"), F.col("first_word").alias("word"), F.col("first_n_words").alias("n_words"), "first_doc_id", "first_part", "first_word", "first_n_words", "passage").distinct()
    out = later.withColumn("removed", F.lit(True)).union(kept.withColumn("removed", F.lit(False)))
    return out.select("doc_id", "part", "word", F.col("n_words").cast("long").alias("n_words"), "passage", "first_doc_id", "first_part", "first_word", F.col("first_n_words").cast("long").alias("first_n_words"), "removed")


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the words that :func:`repeated_passages` says to remove; all other columns and rows stay.

    What goes reaches from a passage's first word to just before the word after it, so the white space around
    it stays once. Only a row whose own id and text have the passage loses it.
    """
    again = repeated_passages(docs, id_col=id_col, text_col=text_col, **options).where("removed")
    names = _shared.fresh(docs, 5)
    again = again.groupBy("doc_id", "part").agg(F.collect_list(F.struct("word", "n_words")).alias("words")).toDF(*names[:3])
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({names[3]: F.col(id_col).cast("long"), names[4]: F.xxhash64(text)})
    both = keyed.join(again, (F.col(names[3]) == F.col(names[0])) & (F.col(names[4]) == F.col(names[1])), "left").drop(*names[:2], *names[3:])
    both = both.withColumn(names[0], text)
    ranges, at = both.columns.index(names[2]), both.columns.index(names[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for r, gone in enumerate(batch.column(ranges).to_pylist()):
                if gone:
                    data, offsets = texts_of(batch.column(at).slice(r, 1))
                    words = words_of(data, offsets, NONSPACE)
                    keep = np.ones(len(words.data), bool)
                    edge = np.append(words.starts, len(words.data))
                    for x in gone:
                        keep[edge[x["word"]] : edge[min(x["word"] + x["n_words"], len(words.starts))]] = False
                    texts[r] = words.data[keep].tobytes().decode()
            columns = [*batch.columns[:ranges], *batch.columns[ranges + 1 : at], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [n for k, n in enumerate(batch.schema.names) if k != ranges])

    kind = dict(docs.dtypes)[text_col]
    done = both.mapInArrow(run, both.drop(names[2]).schema)
    return done.select(*(F.col(names[0]).cast(kind).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(_shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "n_words", "passage", "first_doc_id", "first_word", "first_n_words", "removed")
