"""Repeated passages of several lines: content-defined chunks of lines, removed where they occur again.

A rolling hash over the hashes of neighbouring lines says where a chunk ends, so an inserted line
moves no boundary but its own. Chunks whose hashes occur more than once in the corpus are grouped by
their whole text; all occurrences but the first go. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import _shared

#: A chunk ends after a line where the first hexadecimal digit of the rolling hash is one of these.
ENDS = "01234"
#: Lines and characters that a chunk has at least for its repetitions to be removed.
LINES, CHARS = 2, 40



def _chunked(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` and ``_chunks``: the chunks of its texts in order, each the array of its lines."""
    # each step is a column of its own, so that what a lambda looks up is made once for a text
    rolling = "substring(md5(concat(_hashed[i - 2], _hashed[i - 1])), 1, 1)"
    stops = f"filter(sequence(1, size(_lines)), i -> i = size(_lines) or (i > 1 and instr('{ENDS}', {rolling}) > 0))"
    chunks = "transform(_stops, (e, k) -> slice(_lines, if(k = 0, 1, _stops[k - 1] + 1), if(k = 0, e, e - _stops[k - 1])))"
    out = docs.withColumn("_lines", F.split(F.col(text_col).cast("string"), "\n", -1)).withColumn("_hashed", F.expr("transform(_lines, x -> md5(x))"))
    return out.withColumn("_stops", F.expr(stops)).withColumn("_chunks", F.expr(chunks)).drop("_lines", "_hashed", "_stops")


def _keyed(docs: DataFrame, id_col: str, text_col: str, names: tuple[str, str]) -> DataFrame:
    """``docs`` with its ids, null last, and a hash of the text, which tells rows of one id or of none apart."""
    last = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return docs.withColumns({names[0]: last, names[1]: F.xxhash64(F.col(text_col).cast("string"))})


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, part, places``: of every text with a chunk that an earlier document or place has, the chunks' places.

    Earlier is by id, then place. A null id comes after all others. Rows with one id are one
    document, in which ``part``, the text's hash, says whose places these are; rows without an id are
    one document only if their texts are equal. A null text has no chunk.
    """
    own = _keyed(docs, id_col, text_col, ("_last_id", "_part")).select(F.col("_last_id").alias("doc_id"), F.col("_part").alias("part"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # the outer generators keep the optimizer from making the chunks a second time, for a filter
    chunk = F.struct((F.size("x") >= LINES).alias("many"), F.array_join("x", "\n").alias("chunk"))
    rows = _chunked(own, "text").select("doc_id", "part", F.posexplode_outer("_chunks").alias("place", "x")).select("doc_id", "part", "place", chunk.alias("c")).select("doc_id", "part", "place", "c.*")
    rows = rows.where(F.col("many") & (F.length("chunk") >= CHARS)).select("doc_id", "part", "place", F.xxhash64("chunk").alias("hash"))
    # first only hashes meet; then the texts of those that occur again
    hashes = rows.select("hash", "doc_id", "part", "place")
    often = _shared.cut(hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    where = _shared.cut(hashes.join(often, "hash").groupBy("doc_id", "part").agg(F.collect_set("place").alias("again")))
    picked = F.transform("again", lambda k: F.struct(k.alias("place"), F.array_join(F.get("_chunks", k), "\n").alias("chunk")))
    texts = _chunked(own.join(where, ["doc_id", "part"]), "text").select("doc_id", "part", F.explode_outer(picked).alias("c"))
    texts = _shared.cut(texts.select("doc_id", "part", "c.*").where("chunk is not null"))
    at = F.struct("doc_id", F.when(F.col("doc_id") == (1 << 63) - 1, F.col("part")).alias("of"), "place")
    first = texts.groupBy("chunk").agg(F.min(at).alias("first"))
    later = texts.join(first, "chunk").where(~at.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "part").agg(F.collect_set("place").alias("places"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its repeated chunks cut out of ``text_col``, and ``removed_lines``, how many lines went.

    All other columns stay as they are, whatever their names; a ``removed_lines`` that ``docs`` has already
    is replaced. A text keeps the order and the line ends of what is left; one of which all is repeated
    becomes empty; null stays null with 0 removed. A chunk of one line or of fewer than CHARS characters
    always stays. Rows of equal id and text are cut alike. An empty table gives no rows.
    """
    # all of a row is one column, so that no name of its own meets an inner one
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    again = repeated_chunks(docs, id_col, text_col).toDF("_last_id", "_part", "_places")
    both = _keyed(rows, "id", "text", ("_last_id", "_part")).drop("id", "text").join(again, ["_last_id", "_part"], "left")
    # only a text that loses something is cut up
    text = F.col("row").getField(text_col)
    cut = _chunked(both.withColumn("_text", F.when(F.col("_places").isNotNull(), text)), "_text")
    gone = F.aggregate(F.filter("_chunks", lambda c, k: F.array_contains(F.col("_places"), k)), F.lit(0), lambda n, c: n + F.size(c))
    left = F.array_join(F.flatten(F.filter("_chunks", lambda c, k: ~F.array_contains(F.col("_places"), k))), "\n")
    kind = dict(docs.dtypes)[text_col]
    after = F.struct(F.when(F.col("_places").isNull(), text).otherwise(left.cast(kind)).alias("_after"), F.coalesce(gone, F.lit(0)).cast("long").alias("_gone"))
    # a generator, so that no filter on the results moves below and has the chunks made again for each line
    cut = cut.select("row", F.inline_outer(F.array(after)))
    own = [F.col("_after").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "removed_lines"]
    return cut.select(*own, F.col("_gone").alias("removed_lines"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(_shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
