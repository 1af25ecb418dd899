"""Alignments from BAM files: :func:`read_bam`, or the data source ``spark.read.format("bam").load(path)``.

A block-compressed file is read block by block, one file to a task; convert large ones to Parquet
once and work on that. The data source opens files of a folder that all workers see, in bounded memory;
:func:`read_bam` takes any path that Spark can read, and holds a file's compressed bytes in its task.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "tid int, pos long, mtid int, mpos long, flag int, name string, cigar string, start long, end long, mapq int, seq string, tags map<string, string>"
# Operations of a CIGAR by code, those that consume the reference, bases by code, and tags' numbers by type.
OPERATIONS, ON_REFERENCE = "MIDNSHP=X", "MDN=X"
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_PAIRS = [a + b for a in BASES for b in BASES]


def inflated(stream) -> Iterator[bytes]:
    """The contents of the blocks of a block-compressed stream."""
    while head := stream.read(12):
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block of a BAM file")
        extra = stream.read(struct.unpack("<H", head[10:])[0])
        at, size = 0, None
        while at + 4 <= len(extra):
            tag, n = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
            if tag == b"BC":
                size = struct.unpack("<H", extra[at + 4 : at + 6])[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError("a block without its size")
        body = stream.read(size - 12 - len(extra))
        yield zlib.decompress(body[:-8], -15)


def tags_of(data: bytes) -> dict[str, str]:
    """The optional fields of an alignment, as text; an array's numbers with commas between them."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[name], at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            of, n = NUMBERS[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            out[name] = ",".join(map(str, struct.unpack_from(f"<{n}{of}", data, at + 5)))
            at += 5 + n * struct.calcsize(of)
        elif kind in NUMBERS:
            out[name] = str(struct.unpack_from("<" + NUMBERS[kind], data, at)[0])
            at += struct.calcsize(NUMBERS[kind])
        else:
            raise ValueError(f"a tag of unknown type {kind}")
    return out


def records(stream) -> Iterator[tuple]:
    """The alignments of a BAM stream, as rows of SCHEMA."""
    blocks, held = inflated(stream), bytearray()

    def take(n: int) -> bytes | None:
        while len(held) < n:
            block = next(blocks, None)
            if block is None:
                if held:
                    raise ValueError("the BAM file ends within a record")
                return None
            held.extend(block)
        out = bytes(held[:n])
        del held[:n]
        return out

    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    for _ in range(struct.unpack("<i", take(4))[0]):
        take(struct.unpack("<i", take(4))[0] + 4)
    while (size := take(4)) is not None:
        body = take(struct.unpack("<i", size)[0])
        tid, pos, n_name, mapq, _, n_cigar, flag, n_seq, mtid, mpos, _ = struct.unpack("<iiBBHHHiiii", body[:32])
        name = body[32 : 32 + n_name - 1].decode()
        ops = [(x >> 4, OPERATIONS[x & 15]) for x in struct.unpack(f"<{n_cigar}I", body[32 + n_name : 32 + n_name + 4 * n_cigar])]
        span = sum(n for n, op in ops if op in ON_REFERENCE)
        at = 32 + n_name + 4 * n_cigar
        seq = "".join(map(_PAIRS.__getitem__, body[at : at + (n_seq + 1) // 2]))[:n_seq]
        tags = tags_of(body[at + (n_seq + 1) // 2 + n_seq :])
        yield tid, pos, mtid, mpos, flag, name, "".join(f"{n}{op}" for n, op in ops), pos, pos + span, mapq, seq, tags


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as stream:
            yield from records(stream)


class BamSource(DataSource):
    """Option ``path``: one file, or several with commas between them, in a folder that all workers see."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].split(","))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """The alignments of all files of ``path`` on any file system of Spark's. Bases are as the file has them, of the forward strand."""
    files = spark.sparkContext.binaryFiles(path)
    return spark.createDataFrame(files.flatMap(lambda x: records(io.BytesIO(x[1]))), SCHEMA)
