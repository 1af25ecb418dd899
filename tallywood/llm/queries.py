"""The registered corpus queries and their SQL."""

from __future__ import annotations

from tallywood.llm import ann, collocation, decontam, langid, licenses, linededup, neardup, packing, periodic, pipeline, quality, secrets, substring, tokencount

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        decontam.op2_benchmark_decontamination,
        langid.op3_language_id,
        secrets.op4_secret_scan,
        linededup.op5_line_dedup,
        ann.op6_nearest_neighbours,
        licenses.op7_license_scan,
        substring.op8_substring_dedup,
        quality.op9_quality_classifier,
        neardup.op10_minhash_near_dedup,
        periodic.op11_periodic_runs,
        collocation.op12_phrase_collocations,
        tokencount.op13_token_counts,
    )
}
QUERIES["pipeline"] = pipeline.run

OP2 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
p as (select distinct item, least(13, len(w)) as m, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as t
      from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct m from p),
g as (select doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as t
      from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)),
found as (select doc_id, i, g.m, item from g join p on g.t = p.t and g.m = p.m),
hit as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + m)) as k from found) group by doc_id),
items as (select doc_id, count(distinct item) as n, sha256(string_agg(item, ',' order by item)) as h from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
       coalesce(items.h, sha256('')) as items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

OP5 = r"""
with l as (select doc_id, i, a[i] as line, md5(a[i]) as h, len(a) as n from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null))),
r as (select *, i = n or (i > 1 and substr(md5(concat(lag(h) over (partition by doc_id order by i), h)), 1, 1) in ('0', '1', '2', '3', '4')) as stop from l),
k as (select *, coalesce(sum(cast(stop as int)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from r),
c as (select doc_id, k, count(*) as m, string_agg(line, chr(10) order by i) as chunk from k group by doc_id, k),
f as (select *, m >= 2 and length(chunk) >= 40 and row_number() over (partition by chunk order by doc_id, k) > 1 as gone from c),
t as (select doc_id, cast(sum(case when gone then m else 0 end) as bigint) as removed_lines, string_agg(chunk, chr(10) order by k) filter (where not gone) as text from f group by doc_id)
select d.doc_id, coalesce(removed_lines, 0) as removed_lines, sha256(coalesce(t.text, '')) as text_sha256 from documents d left join t using (doc_id)
"""

OP10 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') as t from (select doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.t = y.t and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
links as (select a, b from e union all select b, a from e),
reach as (select a as x, a as y from links union select reach.x, links.b from reach join links on reach.y = links.a),
least_of as (select x, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join least_of on x = d.doc_id
"""

# crc32 by its table; a stretch of equal words q apart, of 5 or more, shows as places whose next 5 words stand again q on
OP11 = r"""
with recursive bits(b, k, c) as (select b, 0, b from (select unnest(range(0, 256)) as b) union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
tab as (select list(c order by b) as t from bits where k = 8),
ids as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(cast(doc_id as varchar), '')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from (select distinct doc_id from documents), tab),
d as (select doc_id, h, h // 10 as g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents join ids using (doc_id)),
s as (select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then g % len(w) end as a from d),
v as (select doc_id, n, case when a is null then w else [w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end] for i in range(0, n)] end as w from s),
x as (select doc_id, i, array_to_string(w[i + 1:i + 5], ' ') as t from (select doc_id, w, unnest(range(0, n - 4)) as i from v where n > 5)),
m as (select p.doc_id, p.i, y.i - p.i as q from x p join x y on p.doc_id = y.doc_id and p.t = y.t and p.i < y.i),
f as (select doc_id, q, min(i) as start, count(*) + 4 + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as isle from m) group by doc_id, q, isle having count(*) + 4 + q >= greatest(6, 4 * q)),
r as (select doc_id, start, length, min(q) as period from f group by doc_id, start, length),
best as (select doc_id, count(*) as n_runs, arg_min([start, length, period], [-length, start, period]) as b, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as t from r group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
kept as (select doc_id, string_agg(w, ' ' order by i) as t from (select doc_id, unnest(w) as w, unnest(range(0, n)) as i from v) anti join gone using (doc_id, i) group by doc_id)
select v.doc_id, coalesce(n_runs, 0) as n_runs, b[1] as start, b[2] as length, b[3] as period, 1000 * b[2] // b[3] as exponent_milli, sha256(coalesce(best.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from v left join best using (doc_id) left join kept using (doc_id)
"""

OP12 = r"""
with p as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
g as (select lang, m, w[i:i + m - 1] as w from (select lang, m, w, unnest(range(1, len(w) - m + 2)) as i from p, (select unnest([1, 2, 3]) as m) where len(w) >= m)),
f as (select lang, m, array_to_string(w, ' ') as phrase, any_value(w) as w, count(*) as n from g group by lang, m, array_to_string(w, ' ')),
totals as (select lang, cast(sum(n) as bigint) as n from f where m = 1 group by lang),
c as (select lang, phrase, m, w, n as a from f where m > 1 and n >= 10),
cuts as (select lang, phrase, m, w, a, unnest(range(1, m)) as k from c),
s as (select c.lang, c.phrase, m, w, a, k, x.n as l, y.n as r, 1000000::hugeint * a * a // (x.n::hugeint * y.n) as score from cuts c
      join (select lang, phrase, n from f) x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ') join (select lang, phrase, n from f) y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_of as (select lang, phrase, max(a) as more from (select lang, array_to_string(w[i:i + 1], ' ') as phrase, a from (select lang, w, a, unnest([1, 2]) as i from c where m = 3)) group by lang, phrase),
kept as (select b.* from b left join inner_of using (lang, phrase) where more is null or 100 * more < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, totals.n as n, cast(score as bigint) as score from ranked join totals using (lang) where rank <= 2000
"""

ORACLES = {"op2_benchmark_decontamination": OP2, "op5_line_dedup": OP5, "op10_minhash_near_dedup": OP10, "op11_periodic_runs": OP11, "op12_phrase_collocations": OP12}
if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL
