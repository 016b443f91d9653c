"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_LINE_DEDUP = r"""
with lines as (
  select doc_id, i - 1 as i, list_extract(l, i) as line
  from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))
),
hashed as (select *, ('0x' || md5(line)[1:8])::bigint as h from lines),
rolled as (select *, h + 31 * lag(h) over (partition by doc_id order by i) as before, lead(h) over (partition by doc_id order by i) + 31 * h as behind from hashed),
spans as (
  select doc_id, i as first, behind % 4 <> 0 as begins,
    min(case when (before // 4) % 4 <> 0 then i end) over (partition by doc_id order by i rows between 1 following and 15 following) as last
  from rolled
),
chunks as (
  select s.doc_id, s.first, s.last, string_agg(l.line, chr(10) order by l.i) as body
  from spans s join lines l on l.doc_id = s.doc_id and l.i between s.first and s.last where begins and last is not null group by all
),
judged as (
  select *, row_number() over w > 1 as again, lag(first) over (partition by body, doc_id order by first) as prior, first_value(doc_id) over w as first_doc, first_value(first) over w as first_place
  from chunks window w as (partition by body order by doc_id, first)
),
anchors as (
  select doc_id, first, case when prior is null then first_doc else doc_id end as source, first - coalesce(prior, first_place) as shift from judged where again
),
same as (
  select p.doc_id, p.source, p.shift, o.i, o.i - row_number() over (partition by p.doc_id, p.source, p.shift order by o.i) as island
  from (select distinct doc_id, source, shift from anchors) p join lines o on o.doc_id = p.doc_id
  join lines s on s.doc_id = p.source and s.i = o.i - p.shift and s.line = o.line
),
kept_islands as (select distinct s.doc_id, s.source, s.shift, s.island from same s join anchors a on a.doc_id = s.doc_id and a.source = s.source and a.shift = s.shift and a.first = s.i),
gone as (select distinct doc_id, i from same join kept_islands using (doc_id, source, shift, island))
select d.doc_id, n_lines, coalesce(n_chunks, 0) as n_chunks, coalesce(n_removed_chunks, 0) as n_removed_chunks, coalesce(n_removed_lines, 0) as n_removed_lines, coalesce(text, '') as text
from (select doc_id, count(*) as n_lines from lines group by doc_id) d left join (select doc_id, count(*) as n_chunks from chunks group by doc_id) c using (doc_id)
left join (select doc_id, count(*) as n_removed_chunks from anchors group by doc_id) a using (doc_id)
left join (select doc_id, count(*) as n_removed_lines from gone group by doc_id) g using (doc_id)
left join (select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text from lines l anti join gone using (doc_id, i) group by l.doc_id) t using (doc_id)
"""

_WARC = r"""
with t as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
digits as (
  select page_id, html, payload_bytes, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (1 + 5 * i)::int, 5))::bigint) as five from t
),
coded as (
  select page_id, html, payload_bytes, list_aggregate(list_transform(five, lambda n:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31)::int + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31)::int + 1, 1)
  ), 'string_agg', '') as payload_digest from digits
),
firsts as (select *, min(page_id) over (partition by html) as first_id from coded)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from firsts
"""

_EXACT_DEDUP = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as s from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by s) as group_size,
  doc_id = first_value(doc_id) over w as kept, s as text_sha256
from t window w as (partition by s order by n desc, doc_id)
"""

_QUALITY_RULES = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
),
lines as (
  select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
),
windows as (
  select doc_id, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from windows) where n > 1),
covered as (
  select doc_id, count(distinct i + j)::bigint as n_repeat_words from twice, (select unnest([0, 1, 2]) as j) group by doc_id
),
base as (
  select d.doc_id, source, len(w)::bigint as n_words, length(list_aggregate(w, 'string_agg', ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join lines using (doc_id) left join covered using (doc_id)
),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
hosts as (select source, count(*)::double as n, (count(*) filter (base_failed))::double as f from judged where source is not null group by source),
prior as (select avg(f / n) as m, var_pop(f / n) as v from hosts),
strength as (select m, case when v > 0 then greatest(m * (1 - m) / v - 1, 1) else 1 end as s from prior),
rates as (select source, n, s, m, (f + m * s) / (n + s) as rate from hosts, strength),
verdicts as (select source, rate > 0.8 or rate - 3 * sqrt(rate * (1 - rate) / (n + s + 1)) > 4 * m / (1 + 3 * m) as rejected from rates)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(rejected, false) as kept
from judged left join verdicts using (source)
"""

_MINHASH = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
pairs as (
  select doc_id, list_extract(w, i) || ' ' || list_extract(w, i + 1) as s from (select doc_id, w, unnest(range(1, len(w))) as i from w where len(w) > 1)
  union all select doc_id, list_extract(w, 1) from w where len(w) = 1
),
sets as (select distinct doc_id, s from pairs),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id, doc_id as r from documents
  union select reach.doc_id, both_ways.b from reach join both_ways on reach.r = both_ways.a
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select doc_id, min(r) as component_id from reach group by doc_id) left join sizes using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP,
    "op3_warc": _WARC,
    "op5_exact_dedup": _EXACT_DEDUP,
    "op8_minhash": _MINHASH,
    "op7_quality_rules": _QUALITY_RULES,
}
