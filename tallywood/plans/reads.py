"""Registered queries on alignments, and the same in SQL.

Alignments are made of ``orders``: an order is a pair of mates, its customer gives chromosome and
place, and its numbers CIGARs, gaps and bases. One order in ten has lost its second mate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.functions.storage import shared_folder
from tallywood.operators import cigar, coverage, extrapolate, histogram, ordering
from tallywood.plans.catalog import WORDS, _hist_sql, words
from tallywood.plans.registry import query, table
from tallywood.streaming import reorder

# An order's mates, as text for both engines: lengths of operations, the mate's place, kinds of conversion.
_FORWARD = "concat(1 + ok % 4, 'S', 5 + pk % 20, 'M', 1 + ln, 'I', 3 + ok % 11, 'M', 1 + sk % 5, 'D', 4 + pk % 9, '=')"
_BACKWARD = "concat(2 + pk % 7, case when ok % 4 = 0 then '=' else 'M' end, 1 + ok % 3, 'D', 6 + sk % 13, 'M', 1 + ln, 'S')"
_MATE_AT = "pk + (ok * 3 + pk) % 70 - 12"
_BASES = "translate(concat(md5(concat(ok, '|', ln, '|{0}')), md5(concat('{0}|', ln, '|', ok))), '0123456789abcdef', 'ACGTACGTACGTNACG')"
_FORWARD_READ = "1 + ok % 4 + 5 + pk % 20 + 1 + ln + 3 + ok % 11 + 4 + pk % 9"
_BACKWARD_READ = "2 + pk % 7 + 6 + sk % 13 + 1 + ln"
_LINES = ("o_orderkey as ok", "1 + o_orderkey % 7 as ln", "o_custkey as pk", "o_custkey % 23 as sk")
_ONE = f"concat('read/', ok) as name, cast(99 as int) as flag, sk as tid, pk as pos, ok % 60 as mapq, sk as mtid, {_MATE_AT} as mpos, {_FORWARD} as cigar, substr({_BASES.format(1)}, 1, cast({_FORWARD_READ} as int)) as seq, ok % 5 as nm, case when ok % 2 = 0 then 'A' else 'T' end as cv"
_TWO = f"concat('read/', ok) as name, cast(147 as int) as flag, sk as tid, {_MATE_AT} as pos, pk % 60 as mapq, sk as mtid, pk as mpos, {_BACKWARD} as cigar, substr({_BASES.format(2)}, 1, cast({_BACKWARD_READ} as int)) as seq, pk % 4 as nm, case when pk % 2 = 0 then 'A' else 'T' end as cv"
_SQL = f"lines as (select {', '.join(_LINES)} from orders), rows as (select {_ONE} from lines union all select {_TWO} from lines where ok % 10 <> 0)"
_OPS = "ops as (select name, flag, i, cast(n[i] as bigint) as n, o[i] as op from (select name, flag, regexp_extract_all(cigar, '(\\d+)(.)', 1) as n, regexp_extract_all(cigar, '(\\d+)(.)', 2) as o, unnest(range(1, len(regexp_extract_all(cigar, '\\d+')) + 1)) as i from {0}))"
_ON = "op in ('M', 'D', 'N', '=', 'X')"


def alignments(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").selectExpr(*_LINES)
    one = spark.sql(f"select {_ONE} from {{lines}}", lines=lines)
    two = spark.sql(f"select {_TWO} from {{lines}} where ok % 10 <> 0", lines=lines)
    return one.unionByName(two)


_MOVED = "rows2 as (select name, flag, concat(1 + tid % 3, 'I', cigar, 2, 'S', 3, 'M', 1, 'M', 4 + tid % 2, 'I') as cigar from rows)"


@query(f"""with {_SQL}, {_MOVED}, {_OPS.format('rows2')},
b as (select name, flag, min(i) filter (where {_ON}) as f, max(i) filter (where {_ON}) as l from ops group by name, flag),
e as (select name, flag, i, n, case when i < f or i > l then 'S' when op = 'S' then 'I' else op end as op from ops join b using (name, flag)),
g as (select *, case when op = lag(op) over (partition by name, flag order by i) then 0 else 1 end as new from e),
r as (select *, sum(new) over (partition by name, flag order by i) as r from g),
m as (select name, flag, r, sum(n) as n, any_value(op) as op from r group by name, flag, r)
select name, flag, string_agg(concat(n, op), '' order by r) as cigar from m group by name, flag""")
def cigar_corrected(spark, sf_dir):
    """CIGARs with clips inside and insertions outside, put right."""
    rows = alignments(spark, sf_dir)
    text = F.concat((1 + F.col("tid") % 3).cast("string"), F.lit("I"), F.col("cigar"), F.lit("2S3M1M"), (4 + F.col("tid") % 2).cast("string"), F.lit("I"))
    return rows.select("name", "flag", cigar.written(cigar.corrected(cigar.parsed(text))).alias("cigar"))


_CUT = f"""c as (select *, sum(case when {_ON} then n else 0 end) over (partition by name, flag order by i) as upto from ops),
h as (select c.*, upto - n as before, bases, min(case when {_ON} and upto > bases then i end) over (partition by name, flag) as stop from c join wanted using (name, flag)),
head as (select name, flag, i, op, case when i = stop then bases - before else n end as n from h where stop is null or i < stop or (i = stop and bases > before))"""


@query(f"with {_SQL}, wanted as (select name, flag, pos % 50 as bases from rows), {_OPS.format('rows')}, {_CUT} select name, flag, string_agg(concat(n, op), '' order by i) as cigar, cast(sum(case when {_ON} then n else 0 end) as bigint) as length from head group by name, flag")
def cigar_truncated(spark, sf_dir):
    """The part of each alignment that covers the first bases of the reference."""
    rows = alignments(spark, sf_dir).select("name", "flag", cigar.head(cigar.parsed("cigar"), F.col("pos") % 50).alias("ops"))
    return rows.where(F.size("ops") > 0).select("name", "flag", cigar.written(F.col("ops")).alias("cigar"), cigar.reference_length(F.col("ops")).alias("length"))


@query(f"""with {_SQL}, {_OPS.format('rows')},
r as (select *, sum(case when op in ('M', 'I', 'S', '=', 'X') then n else 0 end) over (partition by name, flag order by i) as upto from ops)
select name, flag, string_agg(case when op in ('M', '=', 'X') then substr(seq, cast(upto - n as bigint) + 1, n) when op in ('D', 'N') then repeat('-', n) else '' end, '' order by i) as laid from r join rows using (name, flag) group by name, flag""")
def read_on_reference(spark, sf_dir):
    """The bases of each read laid out on the reference."""
    rows = alignments(spark, sf_dir)
    return rows.select("name", "flag", cigar.applied(F.col("seq"), cigar.parsed("cigar"), "-").alias("laid"))


_TURN = "reverse(translate({0}, 'ACGT', 'TGCA'))"


@query(f"""with {_SQL}, {_OPS.format('rows')},
spans as (select name, flag, sum(case when {_ON} then n else 0 end) as span from ops group by name, flag),
p as (select a.name, a.tid, a.pos, b.pos as bpos, a.pos + x.span as e, b.pos + y.span as be, x.span as aspan, y.span as bspan, a.seq, b.seq as bseq, a.nm, b.nm as bnm, a.cv, b.cv as bcv, a.mapq, b.mapq as bmapq
  from rows a join rows b on a.name = b.name and a.flag = 99 and b.flag = 147 join spans x on x.name = a.name and x.flag = 99 join spans y on y.name = a.name and y.flag = 147),
k as (select *, case when bpos > pos and bpos >= e then 'skip' when bpos > pos then 'overlap' when bpos = pos then 'better' when be > pos then 'truncated' else 'single' end as kind from p),
wanted as (select name, 99 as flag, case kind when 'overlap' then bpos - pos when 'truncated' then be - pos else aspan end as bases from k where kind <> 'single'),
{_CUT},
t as (select k.name, kind, 1 as part, i, n, op from k join head using (name) where kind <> 'better' or aspan >= bspan
  union all select name, kind, 2, 1, bpos - e, 'N' from k where kind = 'skip' and bpos > e
  union all select k.name, kind, 3, i, n, op from k join ops using (name) where ops.flag = 147 and (kind in ('skip', 'overlap') or (kind = 'better' and aspan < bspan))),
g as (select *, case when kind = 'overlap' and part = 3 and i = 1 and op = lag(op) over (partition by name order by part, i) then 0 else 1 end as new from t),
r as (select *, sum(new) over (partition by name order by part, i) as r from g),
m as (select name, r, sum(n) as n, any_value(op) as op from r group by name, r),
f as (select name, string_agg(concat(n, op), '' order by r) as cigar, cast(sum(case when {_ON} then n else 0 end) as bigint) as length from m group by name),
u as (select name, sum(case when op in ('M', 'I', 'S', '=', 'X') then n else 0 end) as used from head group by name)
select name, kind, case when kind = 'better' and aspan < bspan then 144 else 64 end as flag, tid, pos,
  case when kind = 'better' and aspan < bspan then bmapq else mapq end as mapq, cigar, length,
  case when kind = 'better' and aspan < bspan then bseq when kind in ('skip', 'overlap') then concat(substr(seq, 1, cast(used as bigint)), {_TURN.format('bseq')}) else substr(seq, 1, cast(used as bigint)) end as seq,
  case when kind in ('skip', 'overlap') then nm + bnm when kind = 'better' and aspan < bspan then bnm else nm end as nm, case when kind = 'better' and aspan < bspan then bcv else cv end as cv
from k join f using (name) join u using (name)
union all select r.name, 'single', r.flag, r.tid, r.pos, r.mapq, r.cigar, cast(span as bigint), r.seq, r.nm, r.cv from rows r join spans using (name, flag) where r.name not in (select name from k where kind <> 'single')""")
def mates_to_fragments(spark, sf_dir):
    """Mates joined to fragments, whether they overlap, lie apart, begin together or the wrong way round."""
    return cigar.fragments(alignments(spark, sf_dir))


@query(f"with {_SQL} select name, case when flag = 99 then 115 else 131 end as flag, {_TURN.format('seq')} as seq, 'T' as cv from rows")
def alignments_flipped(spark, sf_dir):
    """Every alignment seen from the other strand."""
    return cigar.flipped(alignments(spark, sf_dir)).select("name", "flag", "seq", "cv")


@query(f"""with {_SQL} select name, flag, mapper, nm, case when mapper = 'abismal' then cv when tid % 2 = 0 then 'A' else 'T' end as cv, case when mapper <> 'abismal' and flag = 147 then {_TURN.format('seq')} else seq end as seq
from rows, (select unnest(['abismal', 'bsmap', 'bismark']) as mapper)""")
def tags_standardised(spark, sf_dir):
    """Tags of three mappers in one form."""
    even = F.col("tid") % 2 == 0
    tags = F.create_map(F.lit("NM"), F.col("nm").cast("string"), F.lit("CV"), F.col("cv"), F.lit("ZS"), F.when(even, "+-").otherwise("-+"), F.lit("XR"), F.when(even, "GA").otherwise("CT"))
    rows = alignments(spark, sf_dir).withColumn("tags", tags)
    out = None
    for mapper in ("abismal", "bsmap", "bismark"):
        one = cigar.standardised(rows, mapper).select("name", "flag", F.lit(mapper).alias("mapper"), "nm", "cv", "seq")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {_SQL}, {_OPS.format('rows')}, ends as (select name, flag, sum(case when {_ON} then n else 0 end) as span from ops group by name, flag),
p as (select a.tid, a.pos, a.pos + x.span as ae, b.pos as bpos, b.pos + y.span as be, a.mpos from rows a join rows b on a.name = b.name and a.flag = 99 and b.flag = 147 join ends x on x.name = a.name and x.flag = 99 join ends y on y.name = a.name and y.flag = 147)
select tid, count(*) as pairs, count(*) filter (where mpos = bpos) as mates, count(*) filter (where pos < bpos) as by_start, count(*) filter (where ae <= be) as by_end from p group by tid""")
def mate_predicates(spark, sf_dir):
    """How the mates of each chromosome lie to each other."""
    rows = alignments(spark, sf_dir).withColumn("end", cigar.end_of(F.col("pos"), cigar.parsed("cigar")))
    a, b = rows.where(~cigar.is_reverse(F.col("flag"))).alias("a"), rows.where(cigar.is_reverse(F.col("flag"))).alias("b")
    pairs = a.join(b, F.col("a.name") == F.col("b.name"))
    counted = {"pairs": F.lit(True), "mates": cigar.are_mates("a", "b"), "by_start": cigar.precedes_by_start("a", "b"), "by_end": cigar.precedes_by_end_and_strand("a", "b")}
    return pairs.groupBy("a.tid").agg(*(F.count_if(x).alias(k) for k, x in counted.items()))


# orders as the rows of a file, in order of their keys; a block is a thousand of them
_FILE = "r as (select o_orderkey as place, (o_orderkey // 400) % 9 as chrom, o_custkey as s, o_custkey + o_orderkey % 50 as e from orders), p as (select *, lag(chrom) over (order by place) as pc, lag(s) over (order by place) as ps, lag(e) over (order by place) as pe, row_number() over (order by place) as n from r)"


@query(f"""with {_FILE}, i as (select *, row_number() over (partition by chrom order by place) as k from p where n = 1 or pc <> chrom), f as (select *, max(s) over (partition by chrom order by place rows between unbounded preceding and 1 preceding) as m from r)
select place, 'start' as rule from p where pc = chrom and s < ps union all select place, 'pair' from p where pc = chrom and s < ps and e < pe
union all select place, 'position' from p where chrom < pc or (chrom = pc and s < ps) union all select place, 'returns' from i where k > case when chrom = (select arg_min(chrom, place) from r) then 2 else 1 end
union all select place, 'reach' from f where s + 500 < m""")
def order_violations(spark, sf_dir):
    """Rows that break any rule of order."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey div 1000 as block", "o_orderkey as place", "(o_orderkey div 400) % 9 as chrom", "o_custkey as start", "o_custkey + o_orderkey % 50 as end")
    return ordering.violations(rows, ["block"], "place", rules=ordering.RULES, reach=500, first_may_return=True).select("place", "rule")


_COVERED = "c as (select l_suppkey as chrom, l_partkey // 10 as bin, count(*) as m from lineitem group by 1, 2), h as (select m, count(*) as n from c group by m)"


@query(f"with {_COVERED}, x as (select arg_max(m, [chrom, bin]) as m from c) select m as multiplicity, cast(sum(n) as double) as n_keys from (select m, n from h union all select m, -1 from x union all select 1, case when (select min([chrom, bin]) from c) = [1, 0] then 0 else 1 end) group by m having sum(n) > 0")
def coverage_hist_reference(spark, sf_dir):
    """The coverage histogram as a count of runs gives it that loses its last run and adds one before its first."""
    bins = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as chrom", "l_partkey div 10 as bin")
    return coverage.coverage_histogram(bins, compat="reference", origin=(1, 0))


_HOUR = "epoch_us(ts) // 3600000000"
REACH = 24


@query(f"with c as (select user_id, {_HOUR} as hour, count(*) as count from events group by 1, 2), m as (select user_id, max(hour) as m from c group by 1), d as (select *, row_number() over (partition by user_id order by hour desc) as back from c join m using (user_id) where hour + {REACH} < m) select user_id, hour, count from d where back > 1")
def stream_in_order(spark, sf_dir):
    """A stream of events counted by user and hour; what no later row within a day can change."""
    path, own = f"{sf_dir}/events.parquet", reorder.session_with_state(spark)
    events = own.read.parquet(path)
    files = own.readStream.schema(events.schema)
    in_folder = all(f.rsplit("/", 2)[1] == "events.parquet" for f in events.inputFiles())
    rows = files.parquet(path) if in_folder else files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    hours = rows.selectExpr("user_id", "timestampdiff(HOUR, timestamp_ntz '1970-01-01 00:00:00', ts) as hour")
    folder = shared_folder(spark)
    query = reorder.in_order(hours, ["user_id"], "hour", REACH).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return own.read.schema("user_id long, hour long, count long, late boolean").parquet(f"{folder}/rows").select("user_id", "hour", "count")


@query(f"""with h as ({_hist_sql('w', WORDS)}), s as (select sum(multiplicity * n_keys) as total, sum(n_keys) as d, max(multiplicity) as m, count(*) as n, sum(case when multiplicity = 1 then n_keys else 0 end) as h1, sum(case when multiplicity % 2 = 1 then n_keys else -n_keys end) as two from h),
f as (select multiplicity as j, n_keys / (select h1 from s) * (case multiplicity when 1 then 1 when 2 then 2 when 3 then 6 else 24 end) as mu from h where multiplicity <= 4),
m as (select max(mu) filter (where j = 1) as m0, max(mu) filter (where j = 2) as m1, max(mu) filter (where j = 3) as m2, max(mu) filter (where j = 4) as m3 from f)
select kind, cast(nr as int) as nr, round(value, 4) as value from (select 'total' as kind, 0 as nr, total as value from s union all select 'distinct', 0, d from s union all select 'max_count', 0, m from s union all select 'n_counts', 0, n from s
union all select 'singletons', 0, h1 from s union all select 'two_fold', 0, two from s union all select 'moment', j - 1, mu from f union all select 'alpha', 0, m1 from m union all select 'beta', 0, m0 from m
union all select 'alpha', 1, (m3 - m1 * m2) / (m2 - m1 * m1) - m1 from m union all select 'beta', 1, m2 - m1 * m1 from m)""")
def diagnostics_words(spark, sf_dir):
    """What the estimates from words rest on: totals, moments and the recurrence of a rule of two points."""
    rows = extrapolate.diagnostics(histogram.histogram(words(spark, sf_dir), ["w"]), most_points=2)
    told = ("total", "distinct", "max_count", "n_counts", "singletons", "two_fold", "moment", "alpha", "beta")
    return rows.where(F.col("kind").isin(*told)).select("kind", "nr", F.round("value", 4).alias("value"))
