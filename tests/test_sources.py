import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallywood.operators import cigar, coverage
from tallywood.plans import report
from tallywood.sources import bam, text
from tallywood.streaming import counts


def write(tmp_path, body, name="x.txt"):
    path = tmp_path / name
    path.write_bytes(body.encode())
    return str(path)


def test_histogram_file(spark, tmp_path):
    hist = text.read_histogram(spark, write(tmp_path, "1\t4\n2 3.5\n7\t1e2\n"))
    assert [tuple(r) for r in hist.orderBy("multiplicity").collect()] == [(1, 4.0), (2, 3.5), (7, 100.0)]
    assert report.histogram(hist) == ["1\t4", "2\t3", "7\t100"]


@pytest.mark.parametrize(("body", "what"), [("1\t4\r\n", "carriage return"), ("0\t4\n", "below 1"), ("2\t1\n1\t1\n", "out of order"), ("1\t1\n1\t2\n", "out of order"), ("a\t1\n", "not a line"), ("1\n", "not a line")])
def test_bad_histogram_files(spark, tmp_path, body, what):
    with pytest.raises(Exception, match=what):
        text.read_histogram(spark, write(tmp_path, body)).collect()


def test_counts_file(spark, tmp_path):
    hist = text.read_counts(spark, write(tmp_path, "1\n2\n1\n1\n3\n2\n2\n1\n\n0\nword\n2.7\n0.5\n"))
    assert {r.multiplicity: r.n_keys for r in hist.collect()} == {1: 4.0, 2: 4.0, 3: 1.0}
    for body, what in (("-2\n", "negative"), ("1\r\n", "carriage return")):
        with pytest.raises(Exception, match=what):
            text.read_counts(spark, write(tmp_path, body)).collect()


def test_interval_files(spark, tmp_path):
    bed = text.read_bed(spark, write(tmp_path, "c\t1\t5\tn\t0.5\t+\nc\t2\t6\n\n"))
    assert [tuple(r) for r in bed.orderBy("start").collect()] == [("c", 1, 5, "n", 0.5, "+"), ("c", 2, 6, None, None, None)]
    reads = text.read_mapped_reads(spark, write(tmp_path, "c\t1\t5\tn\t0\t+\tACGN\n"))
    assert reads.first().seq == "ACGN"
    with pytest.raises(Exception, match="not an interval"):
        text.read_bed(spark, write(tmp_path, "c\tx\t5\n")).collect()


def block(data):
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def alignment(tid, pos, name, ops):
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 0, 0, len(ops), 0, 0, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(o)) for n, o in ops)
    return struct.pack("<i", len(body)) + body


def test_bam_file(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data = head + alignment(0, 10, "a", [(20, "M"), (3, "I"), (5, "D")]) + alignment(0, 10, "b", [(9, "M")]) + alignment(-1, -1, "u", [])
    path = tmp_path / "x.bam"
    path.write_bytes(block(data[:70]) + block(data[70:]) + block(b""))
    bam.register(spark)
    rows = spark.read.format("bam").load(str(path))
    assert [(r.name, r.start, r.end, r.cigar) for r in rows.orderBy("name").collect()] == [("a", 10, 35, "20M3I5D"), ("b", 10, 19, "9M"), ("u", -1, -1, "")]
    assert coverage.aligned(rows).count() == 2
    same = bam.read_bam(spark, str(path))
    assert sorted(map(repr, same.collect())) == sorted(map(repr, rows.collect())) and same.schema == rows.schema
    path.write_bytes(block(data[:40]))
    with pytest.raises(Exception, match="ends within a record"):
        bam.read_bam(spark, str(path)).collect()


def test_bases_and_tags_of_a_bam_file(spark, tmp_path):
    def read(name, flag, pos, mate, seq, cv):
        codes = [bam.BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        tags = b"NMC" + bytes([2]) + b"CVA" + cv + b"XZZ" + b"some text\0" + b"XBBs" + struct.pack("<ihh", 2, -1, 300) + b"XFf" + struct.pack("<f", 0.5)
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 37, 0, 1, flag, len(seq), 0, mate, 0) + name + b"\0" + struct.pack("<I", len(seq) << 4) + packed + b"\xff" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    path = tmp_path / "y.bam"
    path.write_bytes(block(head + read(b"r", 99, 10, 13, "ACGTN", b"A") + read(b"r", 147, 13, 10, "TTGA", b"T")) + block(b""))
    rows = bam.read_bam(spark, str(path))
    got = {r.flag: r for r in rows.collect()}
    assert (got[99].seq, got[147].seq, got[99].mapq) == ("ACGTN", "TTGA", 37)
    assert got[99].tags == {"NM": "2", "CV": "A", "XZ": "some text", "XB": "-1,300", "XF": "0.5"}
    # as they are sequenced, mates become a fragment
    read_on = cigar.standardised(rows, "abismal")
    turned = read_on.withColumn("seq", F.when(cigar.is_reverse(F.col("flag")), cigar.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    assert [tuple(r) for r in cigar.fragments(turned).collect()] == [("overlap", "r", 64, 0, 10, 37, "7M", 7, "ACGTTGA", 4, "A")]
    with pytest.raises(ValueError, match="unknown type"):
        bam.tags_of(b"XXq1")


def test_running_histogram(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(k,) for k in "aab"[: n + 1]], "k string").write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = counts.on_each_histogram(stream, ["k"], lambda hist, n: seen.append({r.multiplicity: r.n_keys for r in hist.collect()}), checkpointLocation=f"{tmp_path}/state")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen[-1] == {1: 1.0, 5: 1.0}


def test_a_mapped_read_over_the_width_limit_is_an_error(spark, tmp_path):
    reads = text.read_mapped_reads(spark, write(tmp_path, "c\t1\t5\tn\t0\t+\tACGN\nc\t10\t40\tm\t0\t+\tACGT\n"))
    key = ["chrom", "start", "end", "name", "strand"]
    assert coverage.base_bins(reads, 2, key, max_width=30).count() == coverage.base_bins(reads, 2, key).count()
    with pytest.raises(Exception, match="wider than the limit"):
        coverage.base_bins(reads, 2, key, max_width=29).select("bin").collect()
