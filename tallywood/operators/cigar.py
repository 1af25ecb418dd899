"""Alignments: CIGAR strings as arrays of operations, their edits, and mates joined to fragments.

Everything is an expression over arrays, so it stays in the plan: operations are not exploded to
rows, and only :func:`fragments` shuffles, by what mates have in common. An alignment has ``name,
flag, tid, pos, mapq, mtid, mpos, cigar, seq, nm, cv``, positions from 0, bases of ``seq`` in the
order of sequencing, and ``cv`` the kind of conversion, ``A`` or ``T``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The operations of a CIGAR, those that consume the reference and those that consume the read; bits of an alignment's flag.
OPERATIONS, ON_REFERENCE, ON_READ, SKIP = "MIDNSHP=X", "MDN=X", "MIS=X", "N"
REVERSE, FIRST, SECOND = 16, 64, 128
#: What a fragment keeps of the flag of its first mate.
KEPT_FLAGS = REVERSE | FIRST | SECOND
OPS = "array<struct<n: long, op: string>>"


def _error(*parts: Column | str) -> Column:
    return F.raise_error(F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _once(f):
    """``f`` of operations that are computed once, however often it looks at them."""

    @wraps(f)
    def of(ops: Column, *rest):
        return _let(ops, lambda ops: f(ops, *rest))

    return of


def parsed(cigar: Column | str) -> Column:
    """The operations ``n, op`` of a CIGAR string; ``*`` and the empty string have none, null gives null and anything else an error."""
    cigar = F.col(cigar) if isinstance(cigar, str) else cigar
    n = F.split(F.rtrim(F.translate(cigar, OPERATIONS, " " * len(OPERATIONS))), " ").cast("array<long>")
    ops = F.arrays_zip(n, F.split(F.translate(cigar, "0123456789", ""), "")).cast(OPS)
    none = F.array().cast(OPS)
    return F.when(cigar.isNull(), F.lit(None).cast(OPS)).when(cigar.isin("*", ""), none).when(F.regexp_replace(cigar, rf"\d+[{OPERATIONS}]", "") == "", ops).otherwise(_error("not a CIGAR: ", cigar))


@_once
def written(ops: Column) -> Column:
    """The CIGAR string of operations; ``*`` for none."""
    text = F.array_join(F.transform(ops, lambda o: F.concat(o["n"].cast("string"), o["op"])), "")
    return F.when(F.size(ops) == 0, "*").otherwise(text)


def eats_reference(op: Column) -> Column:
    return F.lit(ON_REFERENCE).contains(op)


def eats_read(op: Column) -> Column:
    return F.lit(ON_READ).contains(op)


def _sum(ops: Column, of) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda n, o: n + F.when(of(o["op"]), o["n"]).otherwise(0))


def reference_length(ops: Column) -> Column:
    """Bases of the reference that operations consume."""
    return _sum(ops, eats_reference)


def read_length(ops: Column) -> Column:
    """Bases of the read that operations consume."""
    return _sum(ops, eats_read)


@_once
def merged(ops: Column) -> Column:
    """Neighbours of one kind made one. Each operation is read a fixed number of times, however many there are."""
    return F.when(ops.isNull() | (F.size(ops) < 2), ops).otherwise(_merged(ops["n"], ops["op"]))


def _merged(n: Column, kinds: Column) -> Column:
    """:func:`merged` of lengths and kinds, one or more, each an array."""

    def of(n: Column, kinds: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(n) - 1), lambda i: (i == 0) | (F.get(kinds, i) != F.get(kinds, i - 1)))

        def one(i: Column, k: Column, at: Column) -> Column:
            long = F.coalesce(F.get(at, k + 1), F.size(n)) - i
            total = F.when(long == 1, F.get(n, i)).otherwise(F.aggregate(F.slice(n, i + 1, long), F.lit(0).cast("long"), lambda s, x: s + x))
            return F.struct(total.alias("n"), F.get(kinds, i).alias("op"))

        return _let(heads, lambda at: F.transform(at, lambda i, k: one(i, k, at)))

    return _let(n, lambda n: _let(kinds, lambda kinds: of(n, kinds)))


@_once
def corrected(ops: Column) -> Column:
    """Whatever stands outside the first and last operation on the reference made a soft clip, soft clips between them insertions, and equal neighbours merged.

    A single operation stays as it is; two or more of which none is on the reference are an error.
    The kinds are edited as one text, a sign for each operation.
    """
    marks = "".join("+" if op in ON_REFERENCE else "-" for op in OPERATIONS)

    def edited(kinds: Column) -> Column:
        def of(on: Column) -> Column:
            before, after = F.instr(on, "+") - 1, F.instr(F.reverse(on), "+") - 1
            inside = F.translate(F.substring(kinds, before + 1, F.length(kinds) - before - after), "S", "I")
            return F.when(before >= 0, F.split(F.concat(F.repeat(F.lit("S"), before), inside, F.repeat(F.lit("S"), after)), ""))

        return _let(F.translate(kinds, OPERATIONS, marks), of)

    def right(kinds: Column) -> Column:
        return F.when(kinds.isNull(), _error("no operation on the reference: ", written(ops))).otherwise(_merged(ops["n"], kinds))

    return F.when(ops.isNull() | (F.size(ops) < 2), ops).otherwise(_let(_let(F.array_join(ops["op"], ""), edited), right))


@_once
def head(ops: Column, bases: Column) -> Column:
    """The operations up to ``bases`` of the reference, the one in which they end cut in two.

    An operation off the reference that comes before the cut stays; past the end all stay.
    """
    # how far each operation on the reference begins; the first that goes beyond ``bases`` is cut
    state = "struct<left: long, stop: boolean, n: int, part: long>"
    begun = F.struct(bases.cast("long").alias("left"), F.lit(False).alias("stop"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("part")).cast(state)

    def step(s: Column, o: Column) -> Column:
        on = eats_reference(o["op"])
        stops = on & (o["n"] > s["left"])
        went = F.struct((s["left"] - F.when(on, o["n"]).otherwise(0)).alias("left"), F.lit(False).alias("stop"), (s["n"] + 1).alias("n"), F.lit(0).cast("long").alias("part"))
        stopped = F.struct(s["left"].alias("left"), F.lit(True).alias("stop"), s["n"].alias("n"), s["left"].alias("part"))
        return F.when(s["stop"], s).when(stops, stopped).otherwise(went).cast(state)

    def cut(s: Column) -> Column:
        part = F.array(F.struct(s["part"].alias("n"), F.get(ops, s["n"])["op"].alias("op")))
        whole = F.slice(ops, F.lit(1), s["n"])
        return F.when(s["part"] > 0, F.concat(whole, part)).otherwise(whole)

    return _let(F.aggregate(ops, begun, step), cut)


def lapped(a: Column, b: Column, bases: Column) -> Column:
    """``a`` up to ``bases`` of the reference, then ``b``; where they meet, operations of one kind are one."""

    def joined(a: Column) -> Column:
        last, first = F.get(a, F.size(a) - 1), F.get(b, 0)
        met = F.struct((last["n"] + first["n"]).alias("n"), first["op"].alias("op"))
        alike = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(met), F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))))
        return F.when((F.size(a) > 0) & (F.size(b) > 0) & (last["op"] == first["op"]), alike).otherwise(F.concat(a, b))

    return _let(head(a, bases), joined)


def apart(a: Column, b: Column, bases: Column) -> Column:
    """``a``, a skip of ``bases`` of the reference, ``b``."""
    return F.concat(a, F.array(F.struct(bases.cast("long").alias("n"), F.lit(SKIP).alias("op"))), b)


def applied(text: Column, ops: Column, filler: str) -> Column:
    """``text``, a sign for each base of the read, laid out on the reference: insertions and clips left out, ``filler`` for deletions and skips.

    A text of another length than the operations have on the read is an error.
    """
    return _let(ops, lambda ops: _applied(text, ops, filler))


def _applied(text: Column, ops: Column, filler: str) -> Column:
    state = "struct<at: int, out: string>"
    begun = F.struct(F.lit(1).alias("at"), F.lit("").alias("out")).cast(state)

    def step(s: Column, o: Column) -> Column:
        n, on, of = o["n"].cast("int"), eats_reference(o["op"]), eats_read(o["op"])
        more = F.when(on & of, F.substring(text, s["at"], n)).when(on, F.repeat(F.lit(filler), n)).otherwise("")
        return F.struct((s["at"] + F.when(of, n).otherwise(0)).alias("at"), F.concat(s["out"], more).alias("out")).cast(state)

    out = F.aggregate(ops, begun, step, lambda s: s["out"])
    return F.when(read_length(ops) == F.length(text), out).when(text.isNull() | ops.isNull(), F.lit(None).cast("string")).otherwise(_error("the CIGAR ", written(ops), " has ", read_length(ops), " bases of a read of ", F.length(text)))


def reverse_complement(seq: Column) -> Column:
    """The other strand, read backwards; what isn't A, C, G or T stays."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(REVERSE) != 0


def end_of(pos: Column, ops: Column) -> Column:
    """The place behind the last base on the reference; an alignment without any takes one."""
    return pos + F.greatest(reference_length(ops), F.lit(1))


def are_mates(a: str, b: str) -> Column:
    """Whether the alignment of alias ``b`` is where that of ``a`` says its mate is, on the other strand."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (x("mtid") == y("tid")) & (x("mpos") == y("pos")) & (is_reverse(x("flag")) != is_reverse(y("flag")))


def precedes_by_start(a: str, b: str) -> Column:
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (x("tid") == y("tid")) & (x("pos") < y("pos"))


def precedes_by_end_and_strand(a: str, b: str) -> Column:
    """By the end of alignments (column ``end``), the forward strand first."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (x("end") < y("end")) | ((x("end") == y("end")) & ~is_reverse(x("flag")) & is_reverse(y("flag")))


def flipped(rows: DataFrame) -> DataFrame:
    """The alignments seen from the other strand: flag and bases turned round, conversion ``T``. A row without a conversion is an error."""
    cv = F.when(F.col("cv").isNull(), _error("no conversion: ", F.col("name"))).otherwise("T")
    return rows.withColumns({"flag": F.col("flag").bitwiseXOR(REVERSE), "seq": reverse_complement(F.col("seq")), "cv": cv})


def standardised(rows: DataFrame, mapper: str, tags: str = "tags") -> DataFrame:
    """``rows``, whose ``tags`` map names to values, with ``nm`` and ``cv`` in one form whatever the mapper.

    ``abismal`` and ``walt`` have ``NM`` and ``CV`` in that form. ``bsmap`` has its conversion in the
    second sign of ``ZS`` (``-``: A), ``bismark`` in ``XR`` (``GA``: A); of both the bases of the
    reverse strand are turned round. A tag that is missing or malformed, or another mapper, is an error.
    """
    tag = lambda name: F.get(F.transform(F.array(F.col(tags)), lambda m: m[name]), 0)
    nm = F.when(tag("NM").isNull(), _error("no NM tag: ", F.col("name"))).otherwise(tag("NM").cast("long"))
    if mapper in ("abismal", "walt"):
        cv = tag("CV")
    elif mapper == "bsmap":
        zs = tag("ZS")
        cv = F.when(zs.isNull() | ~zs.rlike("^[+-]"), _error("no valid ZS tag: ", F.col("name"))).when(F.substring(zs, 2, 1) == "-", "A").otherwise("T")
    elif mapper == "bismark":
        cv = F.when(tag("XR").isNull(), _error("no XR tag: ", F.col("name"))).when(tag("XR") == "GA", "A").otherwise("T")
    else:
        raise ValueError(f"unknown mapper: {mapper}")
    turned = F.when(is_reverse(F.col("flag")), reverse_complement(F.col("seq"))).otherwise(F.col("seq")) if mapper in ("bsmap", "bismark") else F.col("seq")
    return rows.withColumns({"nm": nm, "cv": cv, "seq": turned})


FRAGMENT = ("kind", "name", "flag", "tid", "pos", "mapq", "cigar", "length", "seq", "nm", "cv")


def fragments(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """Mates joined to one alignment each: ``kind, name, flag, tid, pos, mapq, cigar, length, seq, nm, cv``.

    Mates are two alignments of one name that are each where the other says its mate is, one on the
    forward and one on the reverse strand; the former leads. With ``s`` and ``e`` their first and
    end place on the reference:

    * ``skip``: the second begins at or behind the end of the first; a skip fills what is between (none for 0 bases);
    * ``overlap``: it begins inside the first, which counts up to there;
    * ``better``: both begin at one place; the one that covers more of the reference counts, the first of equals;
    * ``truncated``: it begins before the first, which counts up to the second's end where it ends behind the
      first's beginning; otherwise (the mates are apart the wrong way round) both stay ``single``.

    Bases are the first's, up to where it counts, and the second's turned round; ``nm`` is the sum of
    both (``truncated``, ``better``: of the one that counts), everything else the first's. ``length``
    is what the fragment covers of the reference; mates that would cover more than ``longest`` stay
    ``single``, as do alignments without a mate or with nulls in name, flag, tid, pos, mtid, mpos or cigar.
    Rows that have all of these alike are told apart by number only: the k-th goes with the k-th.
    """
    own = rows.select("name", "flag", "tid", "pos", "mapq", "mtid", "mpos", parsed("cigar").alias("ops"), "seq", "nm", "cv")
    own = own.withColumn("end", F.col("pos") + reference_length(F.col("ops")))
    key = ["name", "tid", "pos", "mtid", "mpos"]
    whole = F.lit(True)
    for c in (*key, "flag", "ops"):
        whole = whole & F.col(c).isNotNull()
    alike = Window.partitionBy(*key, is_reverse(F.col("flag"))).orderBy("flag", written(F.col("ops")), "seq", "mapq", "nm", "cv")
    numbered = own.where(whole).withColumn("k", F.row_number().over(alike))
    one, two = numbered.where(~is_reverse(F.col("flag"))).alias("a"), numbered.where(is_reverse(F.col("flag"))).alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    mates = (a("name") == b("name")) & (a("mtid") == b("tid")) & (a("mpos") == b("pos")) & (b("mtid") == a("tid")) & (b("mpos") == a("pos")) & (a("k") == b("k"))
    pairs = one.join(two, mates, "full_outer")

    gap, ahead, shared = b("pos") - a("end"), b("pos") - a("pos"), b("end") - a("pos")
    kind = F.when(a("name").isNull() | b("name").isNull() | (a("tid") != b("tid")), "single").when((gap >= 0) & (ahead > 0), "skip").when(ahead > 0, "overlap").when(ahead == 0, "better").when(shared > 0, "truncated").otherwise("single")
    pairs = pairs.withColumn("kind", kind)
    begin = F.when(F.col("kind").isin("overlap", "truncated"), head(a("ops"), F.when(F.col("kind") == "overlap", ahead).otherwise(shared))).otherwise(a("ops"))
    pairs = pairs.withColumn("begin", begin)
    first_better = reference_length(a("ops")) >= reference_length(b("ops"))
    ops = F.when((F.col("kind") == "skip") & (gap > 0), apart(a("ops"), b("ops"), gap)).when(F.col("kind") == "skip", F.concat(a("ops"), b("ops"))).when(F.col("kind") == "overlap", lapped(a("ops"), b("ops"), ahead)).when((F.col("kind") == "better") & ~first_better, b("ops")).otherwise(F.col("begin"))
    pairs = pairs.withColumn("joined", ops).withColumn("length", reference_length(F.col("joined")))
    joined = (F.col("kind") != "single") & (F.lit(True) if longest is None else F.col("length") <= longest)

    both = F.col("kind").isin("skip", "overlap")
    other = (F.col("kind") == "better") & ~first_better
    used = F.substring(a("seq"), F.lit(1), read_length(F.col("begin")).cast("int"))
    seq = F.when(F.col("kind") == "skip", F.concat(a("seq"), reverse_complement(b("seq")))).when(F.col("kind") == "overlap", F.concat(used, reverse_complement(b("seq")))).when(other, b("seq")).otherwise(used)
    pick = lambda c: F.when(other, b(c)).otherwise(a(c))
    nm = F.when(both, a("nm") + b("nm")).otherwise(pick("nm"))
    of_pair = [F.struct("kind", a("name").alias("name"), pick("flag").bitwiseAND(KEPT_FLAGS).alias("flag"), a("tid").alias("tid"), a("pos").alias("pos"), pick("mapq").alias("mapq"), written(F.col("joined")).alias("cigar"), F.col("length").alias("length"), seq.alias("seq"), nm.alias("nm"), pick("cv").alias("cv"))]

    def alone(x) -> Column:
        return F.struct(F.lit("single").alias("kind"), *(x(c).alias(c) for c in ("name", "flag", "tid", "pos", "mapq")), written(x("ops")).alias("cigar"), reference_length(x("ops")).alias("length"), *(x(c).alias(c) for c in ("seq", "nm", "cv")))

    alone_each = F.filter(F.array(F.when(a("k").isNotNull(), alone(a)), F.when(b("k").isNotNull(), alone(b))), lambda s: s.isNotNull())
    out = pairs.select(F.explode(F.when(joined, F.array(*of_pair)).otherwise(alone_each)).alias("f")).select("f.*")
    rest = own.where(~whole).select(alone(F.col).alias("f")).select("f.*")
    return out.unionByName(rest).select(*FRAGMENT)
