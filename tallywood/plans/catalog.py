"""The registered queries over the star-schema tables, and the same in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.functions.special import duck, fold_change, hash_uniform, ln_gamma, ln_gamma_sql, register_functions
from tallywood.operators import contfrac, coverage, extrapolate, histogram, moments, rarefy
from tallywood.plans.registry import ORACLES, QUERIES, query, table  # noqa: F401

def _hist_sql(keys: str, of: str, by: str = "") -> str:
    """A histogram in SQL: ``by`` columns, multiplicity, n_keys."""
    by = by and by + ", "
    return f"select {by}c as multiplicity, cast(count(*) as double) as n_keys from (select {by}count(*) as c from {of} group by {by}{keys}) group by {by}c"


WORDS = "(select lang, w from (select lang, unnest(string_split_regex(lower(text), '[^a-z]+')) as w from documents) where w <> '')"
PART_SUPP = f"h as ({_hist_sql('l_partkey, l_suppkey', 'lineitem')})"
WORD_HIST = f"h as ({_hist_sql('w', WORDS)})"
DOC_HIST = f"h as ({_hist_sql('text', 'documents')})"


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''")


def doc_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(table(spark, sf_dir, "documents"), ["text"])


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else c for c in df.columns))


# sources' aggregations and histograms


@query(_hist_sql("l_partkey, l_suppkey", "lineitem"))
def hist_part_supp(spark, sf_dir):
    return part_supp(spark, sf_dir)


@query(_hist_sql("w", WORDS))
def hist_words(spark, sf_dir):
    return histogram.histogram(words(spark, sf_dir), ["w"])


@query(_hist_sql("text", "documents"))
def hist_docs_dup(spark, sf_dir):
    return doc_copies(spark, sf_dir)


@query("select cast(trunc(l_quantity) as bigint) as multiplicity, cast(count(*) as double) as n_keys from lineitem where l_quantity >= 1 group by 1")
def hist_from_vals(spark, sf_dir):
    return histogram.histogram_of_counts(table(spark, sf_dir, "lineitem"), "l_quantity")


@query(f"with {WORD_HIST} select multiplicity, n_keys from h where n_keys > 0")
def hist_positive_bins(spark, sf_dir):
    return histogram.positive_bins(hist_words(spark, sf_dir))


@query(f"with {WORD_HIST} select sum(multiplicity * n_keys) as total, sum(n_keys) as \"distinct\", count(*) as n_counts, max(multiplicity) as max_count, sum(case when multiplicity = 1 then n_keys else 0 end) as singletons from h")
def hist_summary(spark, sf_dir):
    return histogram.summary(hist_words(spark, sf_dir))


_KEYED = {
    "words": WORD_HIST,
    "docs": DOC_HIST,
    "part_supp": PART_SUPP,
    "part_date": f"h as ({_hist_sql('l_partkey, l_shipdate', 'lineitem')})",
    "orderkey": f"h as ({_hist_sql('l_orderkey', 'lineitem')})",
    "custkey": f"h as ({_hist_sql('o_custkey', 'orders')})",
    "user": f"h as ({_hist_sql('user_id', 'events')})",
}


def _keyed(spark, sf_dir) -> DataFrame:
    """Histograms of several keys, named by ``sample``."""
    t = lambda name: table(spark, sf_dir, name)
    made = {
        "words": lambda: hist_words(spark, sf_dir), "docs": lambda: doc_copies(spark, sf_dir), "part_supp": lambda: part_supp(spark, sf_dir),
        "part_date": lambda: histogram.histogram(t("lineitem"), ["l_partkey", "l_shipdate"]), "orderkey": lambda: histogram.histogram(t("lineitem"), ["l_orderkey"]),
        "custkey": lambda: histogram.histogram(t("orders"), ["o_custkey"]), "user": lambda: histogram.histogram(t("events"), ["user_id"]),
    }
    out = None
    for name, make in made.items():
        one = make().withColumn("sample", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_ALL = ", ".join(f"{name}_{text}" for name, text in _KEYED.items()) + ", h as (" + " union all ".join(f"select '{name}' as sample, multiplicity, n_keys from {name}_h" for name in _KEYED) + ")"
_TERMS = "runs as (select sample, multiplicity, row_number() over (partition by sample order by multiplicity) as n from h), terms as (select sample, 1 + count(*) filter (where n = multiplicity) as first_zero, least(100, count(*) filter (where n = multiplicity)) as t from runs group by sample)"
_TWO = "two as (select sample, sum(case when multiplicity % 2 = 1 then n_keys else -n_keys end) as two_fold from h group by sample)"


@query(f"with {_ALL}, {_TERMS} select sample, first_zero, t - t % 2 as terms from terms")
def usable_terms(spark, sf_dir):
    return histogram.usable_terms(_keyed(spark, sf_dir), 100, ["sample"])


@query(f"with {_ALL}, {_TWO} select sample, two_fold from two")
def good_toulmin_2x(spark, sf_dir):
    return histogram.good_toulmin(_keyed(spark, sf_dir), ["sample"])


@query(f"with {_ALL}, {_TERMS}, {_TWO} select sample, case when two_fold < 0 then 'saturated' when t - t % 2 < 4 then 'too_shallow' else 'ok' end as status from terms join two using (sample)")
def depth_gate_status(spark, sf_dir):
    # the user histogram may have no first bin and then no terms row in either engine
    return histogram.gate(_keyed(spark, sf_dir), by=["sample"]).select("sample", "status")


@query(f"with {WORD_HIST} select multiplicity - 1 as term, case when multiplicity % 2 = 1 then n_keys else -n_keys end as coefficient from h join (select case when n % 2 = 0 then n else n - 1 end as most from (select least(100, count(*)) as n from (select multiplicity, row_number() over (order by multiplicity) as i from h) where i = multiplicity)) on multiplicity <= most")
def power_series_coeffs(spark, sf_dir):
    return histogram.power_series(hist_words(spark, sf_dir))


# moments grow to hundreds of digits, so their logarithms are compared
@query(f"with {WORD_HIST}, f as (select n_keys as h1 from h where multiplicity = 1), i as (select *, row_number() over (order by multiplicity) as i from h) select multiplicity - 1 as r, round({duck(ln_gamma_sql('(multiplicity + 1)'))} + ln(n_keys) - ln(h1), 6) as ln_moment from i, f where i = multiplicity")
def factorial_moments(spark, sf_dir):
    return _rounded(histogram.factorial_moments(hist_words(spark, sf_dir)).select("r", "ln_moment"), "ln_moment", digits=6)


@query(f"select cast(x as bigint) as x, round({duck(ln_gamma_sql('(x + 1)'))}, 6) as ln_factorial from (select unnest(range(2, 200)) as x)")
def ln_factorial(spark, sf_dir):
    register_functions(spark)
    return spark.range(2, 200).select(F.col("id").alias("x"), F.round(ln_gamma(F.col("id") + 1), 6).alias("ln_factorial"))


# rarefaction


def _rarefy_sql(hist: str, step: str, floor: bool, by: str = "") -> str:
    lg = lambda x: duck(ln_gamma_sql(f"({x})"))
    on, key = (f"on s.{by} = h.{by}", f"{by}, ") if by else ("on true", "")
    one = f"exp(lg_a - lg_b + lg_s) * n_keys"
    unseen = f"case when total - multiplicity >= n then {'floor(' + one + ')' if floor else one} else 0 end"
    group = f"group by {key}n" if by else "group by n"
    return f"""
with {hist}, t as (select {key}sum(multiplicity * n_keys) as total, sum(n_keys) as seen from h {f'group by {by}' if by else ''}),
s as (select {key}total, seen, n, {lg('total - n + 1')} - {lg('total + 1')} as lg_s from (select {key}total, seen, unnest(range({step}, cast(total as bigint) + 1, {step})) as n from t)),
p as (select {'s.' + by + ', ' if by else ''}s.n, s.total, s.seen, s.lg_s, h.multiplicity, h.n_keys,
      {lg('greatest(s.total - h.multiplicity, 0) + 1')} as lg_a, {lg('greatest(s.total - h.multiplicity - s.n, 0) + 1')} as lg_b from s join h {on})
select {key}n, {'' if floor else 'round('}max(seen) - sum({unseen}){'' if floor else ', 3)'} as expected_distinct from p {group}"""


@query(_rarefy_sql(PART_SUPP, "1500", True))
def rarefy_floor_part_supp(spark, sf_dir):
    return rarefy.rarefaction_curve(part_supp(spark, sf_dir), 1500)


@query(_rarefy_sql(WORD_HIST, "20000", False))
def rarefy_exact_words(spark, sf_dir):
    return _rounded(rarefy.rarefaction_curve(hist_words(spark, sf_dir), 20_000, compat="exact"), "expected_distinct", digits=3)


@query(_rarefy_sql(f"h as ({_hist_sql('w', WORDS, 'lang')})", "10000", True, "lang"))
def rarefy_by_group(spark, sf_dir):
    hist = histogram.histogram(words(spark, sf_dir), ["w"], ["lang"])
    return rarefy.rarefaction_curve(hist, 10_000, ["lang"])


@query(f"with {PART_SUPP}, t as (select sum(multiplicity * n_keys) as total from h) select k, round((k * total / 10 - total) / total, 6) as fold_change from t, (select unnest(range(1, 1001)) as k)")
def fold_change_grid(spark, sf_dir):
    """At tenths of the sample, up to a hundred times its size."""
    total = histogram.summary(part_supp(spark, sf_dir)).select("total")
    rows = total.select("total", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(1000).cast("long"))).alias("k"))
    return rows.select("k", F.round(fold_change(F.col("k") * F.col("total") / 10, F.col("total")), 6).alias("fold_change"))


# intervals: supplier as chromosome, part as start, quantity as width

_INTERVALS = "(select l_suppkey as chrom, l_partkey as s, l_partkey + cast(l_quantity as bigint) as e, l_orderkey as ok, l_linenumber as ln from lineitem)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), "l_orderkey", "l_linenumber")


@query(_hist_sql("chrom, s", _INTERVALS))
def se_dedup_count(spark, sf_dir):
    return coverage.deduplicated(intervals(spark, sf_dir))


@query(_hist_sql("chrom, s, e", _INTERVALS))
def pe_dedup_count(spark, sf_dir):
    return coverage.deduplicated(intervals(spark, sf_dir), paired=True)


@query(f"select count(*) as violations from (select s < lag(s) over (partition by chrom order by ok, ln, s, e) as b from {_INTERVALS}) where b")
def sortedness_violations(spark, sf_dir):
    rows = intervals(spark, sf_dir).withColumn("at", F.struct("l_orderkey", "l_linenumber", "start", "end"))
    return coverage.order_violations(rows, "at").agg(F.count("*").alias("violations"))


_FLOOR = f"(select chrom, unnest(range(s // 10, e // 10)) as bin from {_INTERVALS})"


@query(f"select chrom, bin, count(*) as covered from {_FLOOR} group by chrom, bin")
def coverage_bins_floor(spark, sf_dir):
    return coverage.floor_bins(intervals(spark, sf_dir), 10).groupBy("chrom", "bin").agg(F.count("*").alias("covered"))


@query(_hist_sql("chrom, bin", _FLOOR))
def coverage_hist(spark, sf_dir):
    return coverage.coverage_histogram(coverage.floor_bins(intervals(spark, sf_dir), 10))


def _uniform_sql(*parts: str) -> str:
    return "(cast('0x' || substr(md5(concat_ws('|', " + ", ".join(f"cast({p} as varchar)" for p in parts) + ")), 1, 8) as bigint) / 4294967296.0)"


_HASHED = f"""
with i as (select *, (s % 10) / 10.0 as over, s // 10 * 10 as lo from {_INTERVALS}),
m as (select *, lo + case when {_uniform_sql('ok', 'ln', "'start'")} > over then 0 when over > 0 then 10 else 0 end as ms from i),
b as (select *, ms + e - s as me from m),
x as (select *, unnest(range(ms // 10, (me + 9) // 10)) as bin from b where me > ms)
select chrom, bin, count(*) as covered from x where {_uniform_sql('ok', 'ln', 'bin')} <= (least(me, (bin + 1) * 10) - greatest(ms, bin * 10)) / 10.0 group by chrom, bin"""


@query(_HASHED)
def coverage_split_hashed(spark, sf_dir):
    bins = coverage.hashed_bins(intervals(spark, sf_dir), 10, ["l_orderkey", "l_linenumber"])
    return bins.groupBy("chrom", "bin").agg(F.count("*").alias("covered"))


@query("select doc_id, cast(sum(length(replace(replace(text, 'n', ''), 'N', ''))) as bigint) as known, cast(sum(length(text)) as bigint) as bases from documents group by doc_id")
def non_n_bases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("doc_id").agg(F.sum(coverage.known_bases(F.translate("text", "n", "N"))).alias("known"), F.sum(F.length("text")).alias("bases"))


_READS = "(select o_custkey as chrom, o_orderkey % 1000 as s, replace(o_orderpriority, '-', 'N') as seq, o_orderkey as ok from orders)"
_BASES = f"""(select chrom, bin from (select *, unnest(range(s // 10, (s + length(seq) - 1) // 10 + 1)) as bin from {_READS}),
lateral (select length(replace(substr(seq, greatest(bin * 10 - s, 0) + 1, least((bin + 1) * 10 - s, length(seq)) - greatest(bin * 10 - s, 0)), 'N', '')) / 10.0 as part)
where part > 0 and {_uniform_sql('ok', 'bin')} <= part)"""


@query(_hist_sql("chrom, bin", _BASES))
def coverage_by_bases(spark, sf_dir):
    reads = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chrom"), (F.col("o_orderkey") % 1000).alias("start"), F.translate("o_orderpriority", "-", "N").alias("seq"), "o_orderkey")
    return coverage.coverage_histogram(coverage.base_bins(reads, 10, ["o_orderkey"]))


# continued fractions, quick mode

_P = "p as (select max(case when multiplicity = 1 then n_keys end) as p0, -max(case when multiplicity = 2 then n_keys end) as p1, max(case when multiplicity = 3 then n_keys end) as p2, -max(case when multiplicity = 4 then n_keys end) as p3 from h)"
_QD = "q as (select p0, p1 / p0 as a0, p2 / p1 - p1 / p0 as e0, (p3 / p2 - p2 / p1) * (p2 / p1) / (p2 / p1 - p1 / p0) as b0 from p)"
_CF = "p0 / (1 - a0 * t / (1 - e0 * t / (1 - b0 * t)))"


@query(f"with {WORD_HIST}, {_P}, {_QD} select i as term, round(case i when 0 then p0 when 1 then -a0 when 2 then -e0 else -b0 end, 6) as coefficient from q, (select unnest(range(0, 4)) as i)")
def qd_coeffs_deg4(spark, sf_dir):
    return _plain_fraction(hist_words(spark, sf_dir), 4)


def _plain_fraction(hist: DataFrame, degree: int) -> DataFrame:

    def one(pdf):
        import pandas as pd

        p = pdf.sort_values("term")["coefficient"].to_numpy()
        return pd.DataFrame({"term": range(len(p)), "coefficient": contfrac.quotient_difference(p)})

    series = histogram.power_series(hist, degree)
    return _rounded(series.groupBy().applyInPandas(one, "term long, coefficient double"), "coefficient", digits=6)


@query(f"with {WORD_HIST}, {_P}, {_QD} select i as at, round(i * 0.05 * ({_CF}), 4) as y from (select *, i * 0.05 as t from q, (select unnest(range(1, 201)) as i))")
def cf_eval_grid_deg4(spark, sf_dir):

    def one(pdf):
        import numpy as np
        import pandas as pd

        t = np.arange(1, 201) * 0.05
        return pd.DataFrame({"at": range(1, 201), "y": t * contfrac.Fraction.of(pdf.sort_values("term")["coefficient"].to_numpy())(t)})

    series = histogram.power_series(hist_words(spark, sf_dir), 4)
    return _rounded(series.groupBy().applyInPandas(one, "at long, y double"), "y")


@query(f"""with {WORD_HIST}, {_P}, {_QD}, g as (select i, i * 0.05 * ({_CF}) as y from (select *, i * 0.05 as t from q, (select unnest(range(1, 201)) as i))),
d as (select i, y, y - lag(y) over (order by i) as d1, y - 2 * lag(y) over (order by i) + lag(y, 2) over (order by i) as d2 from g)
select count(*) filter (where y < 0) as negative, count(*) filter (where d1 < -1e-9) as falling, count(*) filter (where d2 > 1e-6) as convex, count(*) filter (where y < 0 or d1 < 0 or d2 > 0) = 0 as stable from d""")
def stability_check(spark, sf_dir):
    import pandas as pd

    def one(pdf):
        y = pdf.sort_values("at")["y"].to_numpy()
        d1, d2 = np.diff(y), np.diff(y, 2)
        return pd.DataFrame({"negative": [(y < 0).sum()], "falling": [(d1 < -1e-9).sum()], "convex": [(d2 > 1e-6).sum()], "stable": [contfrac.stable(y)]})

    return cf_eval_exact(spark, sf_dir).groupBy().applyInPandas(one, "negative long, falling long, convex long, stable boolean")


def cf_eval_exact(spark, sf_dir):
    """The fraction of four terms on a grid of 200 fold changes, by Catalyst expressions alone."""
    h = hist_words(spark, sf_dir)
    of = lambda k: F.max(F.when(F.col("multiplicity") == k, F.col("n_keys") * (1 if k % 2 else -1)))
    p = h.agg(*(of(k).alias(f"p{k - 1}") for k in range(1, 5)))
    q = p.selectExpr("p0", "p1 / p0 as a0", "p2 / p1 - p1 / p0 as e0", "(p3 / p2 - p2 / p1) * (p2 / p1) / (p2 / p1 - p1 / p0) as b0")
    g = q.select("*", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("at")).withColumn("t", F.col("at") * F.lit(0.05))
    return g.select("at", F.expr(f"t * ({_CF})").alias("y"))


#: Step and end of extrapolated curves, in multiples of a sample's total.
FOLDS = 0.5, 1000


def _quick_sql(hists: str, step: float, most: float, by: str = "", times: int = 1) -> str:
    """The curves of the histograms ``h(sample, multiplicity, n_keys)`` of ``hists``: the fraction of least degree that is stable, of all even ones."""
    lg = lambda x: duck(ln_gamma_sql(f"({x})"))
    below = "list_reduce(list_prepend(cast(1 as double), list_reverse(c[2:])), lambda b, x: 1 + x * t / b)"
    return f"""
with recursive {hists}, {_TERMS}, {_TWO},
tot as (select sample, sum(multiplicity * n_keys) as total, sum(n_keys) as seen from h group by sample),
judged as (select sample, t - t % 2 as terms, case when two_fold < 0 then 'saturated' when t - t % 2 < 4 then 'too_shallow' else 'ok' end as status from terms join two using (sample)),
series as (select sample, terms, list(case when multiplicity % 2 = 1 then n_keys else -n_keys end order by multiplicity) as p from h join judged using (sample) where status = 'ok' and multiplicity <= terms group by sample, terms),
qd as (select sample, terms, [p[1]] as c, [p[i + 1] / p[i] for i in range(1, len(p))] as q, [cast(0 as double) for i in range(0, len(p))] as d from series
  union all select sample, terms, list_concat(c, [-q[1], -e[1]]), [q[i + 1] * e[i + 1] / e[i] for i in range(1, len(e))], e
  from (select sample, terms, c, q, [q[i + 1] - q[i] + d[i + 1] for i in range(1, len(q))] as e from qd where len(c) + 1 < terms)),
whole as (select sample, terms, list_append(c, -q[1]) as c from qd where len(c) + 1 = terms),
cuts as (select sample, degree, c[1:degree] as c from (select sample, c, unnest(case when terms <= 6 then [terms] else range(8, terms + 1, 2) end) as degree from whole)),
grid as (select 1 as i, cast(0.05 as double) as t union all select i + 1, t + cast(0.05 as double) from grid where i < 2000),
y0 as (select sample, degree, i, t * (c[1] / {below}) as y from cuts, grid),
y1 as (select *, y - coalesce(lag(y) over (partition by sample, degree order by i), 0) as d1 from y0),
y2 as (select *, d1 - lag(d1) over (partition by sample, degree order by i) as d2 from y1),
good as (select sample, degree from y2 group by sample, degree having bool_and(coalesce(isfinite(y) and y >= 0 and d1 >= 0 and (i = 1 or d2 <= 0), false))),
best as (select sample, c, total, seen from (select sample, min(degree) as degree from good group by sample) join cuts using (sample, degree) join tot using (sample)),
points as (select *, (x - total) / total as t from (select *, unnest(range(1, {int(np.ceil(most / step))})) * ({step} * total) as x from best)),
near as (select sample, x, max(seen) - sum(case when total - multiplicity >= x then floor(exp({lg('greatest(total - multiplicity, 0) + 1')} - {lg('greatest(total - multiplicity - x, 0) + 1')} + {lg('total - x + 1')} - {lg('total + 1')}) * n_keys) else 0 end) as y from points join h using (sample) where x < total group by sample, x),
found as (select sample, x, y, 'ok' as status from near union all select sample, x, seen + t * (c[1] / {below}), 'ok' from points where x >= total
  union all select sample, cast(null as double), cast(null as double), case when status = 'ok' then 'unstable' else status end from judged where sample not in (select sample from best))
select {by and by + ', '}round(x * {times}, 4) as x, round(y * {times}, 4) as expected_distinct, status from found"""


def _one(hist: str) -> str:
    return f"h as (select '' as sample, * from ({hist}))"


@query(_quick_sql(_one(_hist_sql("w", WORDS)), *FOLDS))
def quick_extrap_words(spark, sf_dir):
    return _rounded(extrapolate.quick_curve(hist_words(spark, sf_dir), *FOLDS, in_totals=True), "expected_distinct")


@query(_quick_sql(_ALL, *FOLDS, by="sample"))
def quick_extrap_samples(spark, sf_dir):
    return _rounded(extrapolate.quick_curve(_keyed(spark, sf_dir), *FOLDS, by=["sample"], in_totals=True), "expected_distinct")


@query(_quick_sql(_one(_hist_sql("text", "documents")), *FOLDS))
def quick_extrap_docs_dup(spark, sf_dir):
    return _rounded(extrapolate.quick_curve(doc_copies(spark, sf_dir), *FOLDS, in_totals=True), "expected_distinct")


@query(_quick_sql(_one(_hist_sql("chrom, bin", _FLOOR)), *FOLDS, times=10))
def gc_extrap_quick(spark, sf_dir):
    """In bases: bins of 10 times their size."""
    bins = extrapolate.quick_curve(coverage_hist(spark, sf_dir), *FOLDS, in_totals=True)
    return _rounded(bins.withColumns({c: F.col(c) * 10 for c in ("x", "expected_distinct")}), "expected_distinct")


# richness bounds


@query(f"with {WORD_HIST} select round(sum(n_keys) + max(case when multiplicity = 1 then n_keys end) * (max(case when multiplicity = 1 then n_keys end) / (2 * max(case when multiplicity = 2 then n_keys end))), 4) as estimate, 1 as n_points from h")
def bound_quick_1pt(spark, sf_dir):
    return _rounded(extrapolate.quick_bound(hist_words(spark, sf_dir), 1), "estimate")


@query(None)
def bound_quick_words(spark, sf_dir):
    return _rounded(extrapolate.quick_bound(hist_words(spark, sf_dir)), "estimate", digits=3)


@query(None)
def bound_quick_samples(spark, sf_dir):
    return _rounded(extrapolate.quick_bound(_keyed(spark, sf_dir), by=["sample"]), "estimate", digits=3)


_MU = "m as (select 1.0 as m0, max(case when multiplicity = 2 then n_keys end) * 2 / h1 as m1, max(case when multiplicity = 3 then n_keys end) * 6 / h1 as m2, max(case when multiplicity = 4 then n_keys end) * 24 / h1 as m3, max(h1) as h1, sum(n_keys) as seen from h, (select n_keys as h1 from h where multiplicity = 1) group by h1)"


@query(f"with {WORD_HIST}, {_MU} select round(m2 - m1 * m1, 6) as det, round(m1 * m3 - m2 * m2, 6) as shifted from m")
def hankel_det_2x2(spark, sf_dir):
    import pandas as pd

    def one(pdf):
        m = moments.moments_of(contfrac.Histogram.of(pdf["multiplicity"], pdf["n_keys"]).head(5), 4)
        det, shifted = moments.determinants(m, 2)
        return pd.DataFrame({"det": [det], "shifted": [shifted]})

    few = hist_words(spark, sf_dir).where("multiplicity <= 4").select("multiplicity", "n_keys")
    return few.groupBy().applyInPandas(one, "det double, shifted double").selectExpr("round(det, 6) as det", "round(shifted, 6) as shifted")


@query(f"""with {WORD_HIST}, {_MU}, c as (select *, m1 as a0, (m3 - m1 * m2) / (m2 - m1 * m1) - m1 as a1, m2 - m1 * m1 as b1 from m),
x as (select *, (a0 + a1) / 2 - sqrt(pow((a0 - a1) / 2, 2) + b1) as x1, (a0 + a1) / 2 + sqrt(pow((a0 - a1) / 2, 2) + b1) as x2 from c)
select round(seen + h1 * ((x2 - a0) / (x2 - x1) / x1 + (a0 - x1) / (x2 - x1) / x2), 3) as estimate, 2 as n_points from x""")
def bound_quick_2pt(spark, sf_dir):
    return _rounded(extrapolate.quick_bound(hist_words(spark, sf_dir), 2), "estimate", digits=3)


@query(f"with {PART_SUPP} select round(sum(n_keys) + sum(case when multiplicity = 1 then n_keys else 0 end) * (sum(case when multiplicity = 1 then n_keys else 0 end) - 1) / (2 * (sum(case when multiplicity = 2 then n_keys else 0 end) + 1)), 4) as chao1 from h")
def chao1_fallback(spark, sf_dir):
    return _rounded(histogram.chao1(part_supp(spark, sf_dir)), "chao1")


@query(f"with {PART_SUPP} select round(sum(n_keys) / (1 - exp(-2 * sum(case when multiplicity = 2 then n_keys end) / sum(case when multiplicity = 1 then n_keys end))), 4) as zelterman from h")
def zelterman_fallback(spark, sf_dir):
    return _rounded(histogram.zelterman(part_supp(spark, sf_dir)), "zelterman")


# bootstrap, limits and population size


@query("select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.025), 4) as lower, round(quantile_cont(l_extendedprice, 0.975), 4) as upper from lineitem group by l_returnflag, l_linestatus")
def percentile_ci_of_replicates(spark, sf_dir):
    out = extrapolate.percentile_limits(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return _rounded(out, "median", "lower", "upper")


@query(None)
def bootstrap_curve_ci(spark, sf_dir):
    hist = extrapolate.local(hist_words(spark, sf_dir))
    total = histogram.summary(hist).first().total
    return extrapolate.lc_extrap(hist, *(f * total for f in FOLDS))


@query(None)
def gc_extrap_ci(spark, sf_dir):
    """Bases of covered bins, with limits: a word is a read of 20 bases, from the place on that its checksum names."""
    reads = words(spark, sf_dir).select(F.col("lang").alias("chrom"), (F.crc32("w") % (1 << 24) * 10).alias("start"))
    reads = reads.withColumn("end", F.col("start") + 20)
    hist = extrapolate.local(coverage.coverage_histogram(coverage.floor_bins(reads, 10)))
    total = histogram.summary(hist).first().total
    return extrapolate.gc_extrap(hist, 10, *(10 * f * total for f in FOLDS))


@query(None)
def bootstrap_bound_ci(spark, sf_dir):
    return extrapolate.bound_pop(hist_words(spark, sf_dir))


@query(f"with {PART_SUPP} select sum(n_keys) * 1e9 as most, round((sum(n_keys) * 1e9 - sum(n_keys)) / 50, 2) as step from h")
def pop_size_horizon(spark, sf_dir):
    return _rounded(extrapolate.horizon(part_supp(spark, sf_dir)), "step", digits=2)


_RUNNING = "(select user_id, cast(value as decimal(18, 6)) as inc, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by event_id desc) as back from events)"


@query(f"select user_id, n >= 3 and inc < 1 as converged from {_RUNNING} where back = 1")
def pop_size_convergence(spark, sf_dir):
    """Of each user's running sum, in exact decimals."""
    running = Window.partitionBy("user_id").orderBy("event_id")
    value = F.col("value").cast("decimal(18,6)")
    curve = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), F.sum(value).over(running).alias("y"))
    return extrapolate.converged(curve, ["user_id"]).select("user_id", "converged")


@query(None)
def pop_size_words(spark, sf_dir):
    return extrapolate.pop_size(hist_words(spark, sf_dir))


@query("select l_orderkey, l_linenumber, round(" + _uniform_sql("l_orderkey", "l_linenumber") + ", 9) as u from lineitem")
def hashed_uniform(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(hash_uniform(F.col("l_orderkey"), F.col("l_linenumber")), 9).alias("u"))


@query("select n, cast(sum(x) as bigint) as bases from (select o_orderkey % 50 as n, (o_orderkey % 90 + 1) + (o_custkey % 30 + 1) as x from orders) group by n")
def reference_length_of_cigar(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = F.format_string("%dM3I%dD2S", F.col("o_orderkey") % 90 + 1, F.col("o_custkey") % 30 + 1)
    return orders.groupBy((F.col("o_orderkey") % 50).alias("n")).agg(F.sum(coverage.reference_length(text)).alias("bases"))
