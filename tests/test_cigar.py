import random
import re

import pytest
from pyspark.sql import functions as F

from tallywood.operators import cigar

REF, READ = "MDN=X", "MIS=X"
ROW = "name string, flag int, tid int, pos long, mapq int, mtid int, mpos long, cigar string, seq string, nm long, cv string"


def ops_of(text):
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text)]


def text_of(ops):
    return "".join(f"{n}{op}" for n, op in ops) or "*"


def length(ops, kinds):
    return sum(n for n, op in ops if op in kinds)


def plain_merged(ops):
    out = []
    for n, op in ops:
        if out and out[-1][1] == op:
            out[-1] = (out[-1][0] + n, op)
        else:
            out.append((n, op))
    return out


def plain_corrected(ops):
    if len(ops) < 2:
        return ops
    on = [i for i, (_, op) in enumerate(ops) if op in REF]
    return plain_merged([(n, "S" if not on[0] <= i <= on[-1] else "I" if op == "S" else op) for i, (n, op) in enumerate(ops)])


def plain_head(ops, bases):
    out = []
    for n, op in ops:
        if op in REF:
            if n > bases:
                return [*out, (bases, op)] if bases else out
            bases -= n
        out.append((n, op))
    return out


def plain_applied(text, ops, filler):
    out, at = "", 0
    for n, op in ops:
        if op in READ:
            out += text[at : at + n] if op in REF else ""
            at += n
        elif op in REF:
            out += filler * n
    assert at == len(text)
    return out


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_fragments(rows, longest=None):
    """One pair after another; mates are looked for by going through all later rows."""
    end = lambda r: r["pos"] + length(ops_of(r["cigar"]), REF)
    single = lambda r: ("single", r["name"], r["flag"], r["tid"], r["pos"], r["mapq"], r["cigar"], length(ops_of(r["cigar"]), REF) if r["cigar"] is not None else None, r["seq"], r["nm"], r["cv"])
    whole = [r for r in rows if all(r[c] is not None for c in ("name", "flag", "tid", "pos", "mtid", "mpos", "cigar"))]
    out = [single(r) for r in rows if r not in whole]
    order = sorted(whole, key=lambda r: tuple(r[c] for c in ("name", "flag", "cigar", "seq", "mapq", "nm", "cv")))
    ahead, back = [r for r in order if not r["flag"] & 16], [r for r in order if r["flag"] & 16]
    for a in ahead:
        b = next((b for b in back if (a["name"], a["mtid"], a["mpos"], a["tid"], a["pos"]) == (b["name"], b["tid"], b["pos"], b["mtid"], b["mpos"])), None)
        if b is None:
            out.append(single(a))
            continue
        back.remove(b)
        x, y = ops_of(a["cigar"]), ops_of(b["cigar"])
        flag, nm, lead = a["flag"] & 208, a["nm"] + b["nm"], a
        if a["tid"] == b["tid"] and b["pos"] > a["pos"] and b["pos"] >= end(a):
            kind, ops, seq = "skip", x + ([(b["pos"] - end(a), "N")] if b["pos"] > end(a) else []) + y, a["seq"] + turned(b["seq"])
        elif a["tid"] == b["tid"] and b["pos"] > a["pos"]:
            first = plain_head(x, b["pos"] - a["pos"])
            ops = first[:-1] + [(first[-1][0] + y[0][0], y[0][1])] + y[1:] if first and y and first[-1][1] == y[0][1] else first + y
            kind, seq = "overlap", a["seq"][: length(first, READ)] + turned(b["seq"])
        elif a["tid"] == b["tid"] and b["pos"] == a["pos"]:
            lead = a if length(x, REF) >= length(y, REF) else b
            kind, ops, seq, nm, flag = "better", ops_of(lead["cigar"]), lead["seq"], lead["nm"], lead["flag"] & 208
            seq = seq[: length(x, READ)] if lead is a else seq
        elif a["tid"] == b["tid"] and end(b) > a["pos"]:
            ops = plain_head(x, end(b) - a["pos"])
            kind, seq, nm = "truncated", a["seq"][: length(ops, READ)], a["nm"]
        else:
            out += [single(a), single(b)]
            continue
        if longest is not None and length(ops, REF) > longest:
            out += [single(a), single(b)]
            continue
        out.append((kind, a["name"], flag, a["tid"], a["pos"], lead["mapq"], text_of(ops), length(ops, REF), seq, nm, lead["cv"]))
    out += [single(r) for r in back]
    return sorted(out, key=repr)


def random_ops(draw, most=7):
    return [(draw.randrange(1, 9), draw.choice("MMMIDNSHP=X")) for _ in range(draw.randrange(1, most))]


def test_parsing(spark):
    rows = spark.createDataFrame([(0, "5M"), (1, "*"), (2, ""), (3, None), (4, "10S3=1X2H1P4D5N6I")], "i int, cigar string").select("i", cigar.parsed("cigar").alias("ops"))
    got = {r.i: r for r in rows.select("i", "ops", cigar.written(F.col("ops")).alias("t"), cigar.reference_length(F.col("ops")).alias("a"), cigar.read_length(F.col("ops")).alias("b")).collect()}
    assert [got[i].t for i in range(5)] == ["5M", "*", "*", None, "10S3=1X2H1P4D5N6I"]
    assert (got[4].a, got[4].b, got[1].a) == (13, 20, 0)
    for bad in ("5", "M5", "5M 3I", "5Q"):
        with pytest.raises(Exception, match="not a CIGAR"):
            spark.createDataFrame([(bad,)], "cigar string").select(cigar.parsed("cigar")).collect()


def test_edits_against_plain_versions(spark):
    draw = random.Random(4)
    rows = [(i, text_of(random_ops(draw)), draw.randrange(40)) for i in range(400)] + [(400, "*", 3), (401, None, 3), (402, "M".join(map(str, range(1, 3000))) + "M", 100)]
    df = spark.createDataFrame(rows, "i int, cigar string, n int").withColumn("ops", cigar.parsed("cigar"))
    one = df.where(F.size("ops") < 2).unionByName(df.where(F.exists("ops", lambda o: cigar.eats_reference(o["op"])))).distinct()
    got = {r.i: r for r in one.select("i", cigar.written(cigar.corrected(F.col("ops"))).alias("c"), cigar.written(cigar.head(F.col("ops"), F.col("n"))).alias("h"), cigar.written(cigar.merged(F.col("ops"))).alias("m")).collect()}
    assert len(got) > 300 and {400, 402} <= set(got)
    for i, text, n in rows:
        if i in got and text is not None:
            ops = ops_of(text)
            assert (got[i].c, got[i].h, got[i].m) == tuple(map(text_of, (plain_corrected(ops), plain_head(ops, n), plain_merged(ops)))), text
    nulls = df.where("i = 401").select(cigar.written(cigar.corrected(F.col("ops"))).alias("c"), cigar.head(F.col("ops"), F.col("n")).alias("h")).first()
    assert (nulls.c, nulls.h) == (None, None)
    with pytest.raises(Exception, match="no operation on the reference"):
        spark.createDataFrame([("3S4I",)], "cigar string").select(cigar.corrected(cigar.parsed("cigar"))).collect()


def test_texts_laid_out_on_the_reference(spark):
    draw = random.Random(5)
    rows = []
    for i in range(300):
        ops = random_ops(draw)
        rows.append((i, text_of(ops), "".join(draw.choice("ab.*é") for _ in range(length(ops, READ)))))
    df = spark.createDataFrame([*rows, (300, None, "x"), (301, "5M", None), (302, "*", "")], "i int, cigar string, t string")
    got = {r.i: r.o for r in df.select("i", cigar.applied(F.col("t"), cigar.parsed("cigar"), "N").alias("o")).collect()}
    assert all(got[i] == plain_applied(t, ops_of(c), "N") for i, c, t in rows)
    assert (got[300], got[301], got[302]) == (None, None, "")
    with pytest.raises(Exception, match="5 bases of a read of 4"):
        spark.createDataFrame([("5M", "abcd")], "c string, t string").select(cigar.applied(F.col("t"), cigar.parsed("c"), "N")).collect()


def random_mates(seed, n):
    draw, rows = random.Random(seed), []

    def one(name, flag, tid, pos, mtid, mpos):
        ops = random_ops(draw)
        return dict(name=name, flag=flag, tid=tid, pos=pos, mapq=draw.randrange(60), mtid=mtid, mpos=mpos, cigar=text_of(ops), seq="".join(draw.choice("ACGTN") for _ in range(length(ops, READ))), nm=draw.randrange(5), cv=draw.choice("AT"))

    for i in range(n):
        tid, pos = draw.randrange(2), draw.randrange(60)
        tid2, pos2 = (tid, max(0, pos + draw.randrange(-12, 30))) if draw.random() < 0.9 else (2, 5)
        name = f"r{draw.randrange(n)}" if draw.random() < 0.2 else f"p{i}"
        a, b = one(name, 64 | draw.choice([0, 2, 32]), tid, pos, tid2, pos2), one(name, 128 | 16, tid2, pos2, tid, pos)
        rows += [a, b] if draw.random() < 0.8 else [draw.choice([a, b])]
        if draw.random() < 0.1:
            rows += [dict(a), dict(b)]
        if draw.random() < 0.1:
            rows.append(dict(a) | {draw.choice(["name", "flag", "tid", "pos", "mtid", "mpos", "cigar"]): None})
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("longest", [None, 30])
def test_fragments_of_random_mates(spark, longest):
    rows = random_mates(7, 250)
    names = [c.split()[0] for c in ROW.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ROW).withColumns({"kind": F.lit("x"), "ops": F.lit("y"), "k": F.lit(1)})
    got = sorted(map(tuple, cigar.fragments(df, longest).collect()), key=repr)
    assert got == plain_fragments(rows, longest)
    assert {r[0] for r in got} == {"skip", "overlap", "better", "truncated", "single"}
    assert cigar.fragments(df.where("false")).collect() == []


def test_strands_and_tags(spark):
    rows = [("a", 16, "ACCGTN", "A", {"NM": "3", "ZS": "+-", "XR": "GA", "CV": "T"}), ("b", 0, "AACC", "T", {"NM": "0", "ZS": "-+", "XR": "CT", "CV": "A"})]
    df = spark.createDataFrame(rows, "name string, flag int, seq string, cv string, tags map<string, string>")
    assert [tuple(r) for r in cigar.flipped(df).select("flag", "seq", "cv").collect()] == [(0, "NACGGT", "T"), (16, "GGTT", "T")]
    assert [tuple(r) for r in cigar.standardised(df, "bsmap").select("nm", "cv", "seq").collect()] == [(3, "A", "NACGGT"), (0, "T", "AACC")]
    assert [tuple(r) for r in cigar.standardised(df, "bismark").select("nm", "cv", "seq").collect()] == [(3, "A", "NACGGT"), (0, "T", "AACC")]
    assert [tuple(r) for r in cigar.standardised(df, "abismal").select("nm", "cv", "seq").collect()] == [(3, "T", "ACCGTN"), (0, "A", "AACC")]
    with pytest.raises(ValueError, match="unknown mapper"):
        cigar.standardised(df, "other")
    bad = df.withColumn("tags", F.expr("map('NM', '1', 'ZS', '?')"))
    for mapper in ("bsmap", "bismark"):
        with pytest.raises(Exception, match="tag"):
            cigar.standardised(bad, mapper).collect()
    with pytest.raises(Exception, match="no NM tag"):
        cigar.standardised(df.withColumn("tags", F.expr("map('ZS', '++')")), "bsmap").collect()
    with pytest.raises(Exception, match="no conversion"):
        cigar.flipped(df.withColumn("cv", F.lit(None).cast("string"))).collect()


def test_operations_are_computed_once(spark):
    rows = spark.createDataFrame([("2I3S4M5S1M1M2I",)], "cigar string")
    out = rows.select(cigar.written(cigar.corrected(cigar.parsed("cigar"))).alias("cigar"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "regexp_extract_all" not in plan
    assert out.first().cigar == "5S4M5I2M2S"


def test_correcting_and_merging_at_the_edges(spark):
    texts = ["7I", "3S2S", "1M", "2I1M", "1M2I", "1M1M", "1M1M1M2S3S", "5H4S3M2S1H", "4S1D2I2S1X9P", "3=3=2S2I3=", "00012M1M", "5M" * 3000 + "1I2M" * 3000, "*", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, cigar string").select("i", cigar.parsed("cigar").alias("ops"))
    for r in rows.select("i", cigar.written(cigar.merged(F.col("ops"))).alias("m"), cigar.written(F.col("ops")).alias("w")).collect():
        ops = None if texts[r.i] is None else ops_of(texts[r.i])
        assert (r.m, r.w) == ((None, None) if ops is None else (text_of(plain_merged(ops)), text_of(ops)))
    for r in rows.where("i <> 1").select("i", cigar.written(cigar.corrected(F.col("ops"))).alias("c")).collect():
        assert r.c == (None if texts[r.i] is None else text_of(plain_corrected(ops_of(texts[r.i]))))
    with pytest.raises(Exception, match="no operation on the reference: 3S2S"):
        rows.where("i = 1").select(cigar.corrected(F.col("ops"))).collect()
    for bad in ("5M\n", "5M ", " 5M", "5MM", "M", "5M6", "5٣M", "5M*"):
        with pytest.raises(Exception, match="not a CIGAR"):
            spark.createDataFrame([(bad,)], "cigar string").select(cigar.parsed("cigar")).collect()
