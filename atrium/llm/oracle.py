"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIX = rf"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {SPACED})) as size, md5('mix-1|' || coalesce(cast(doc_id as varchar), '|' || md5(coalesce(text, '')))) as place from documents),
s as (select source, sum(size)::bigint as n, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
o as (select *, sum(n) over (order by n / w, source nulls last) as n_upto, sum(w) over () - sum(w) over (order by n / w, source nulls last) + w as w_from, sum(n) over () as total from s where n > 0),
k as (select *, total - 3 * (n_upto - n) as room, room * w / w_from <= 3 * n as fits from o),
f as (select room as l, w_from as lw, n / w as edge from k where fits order by n / w, source nulls last limit 1),
t as (select s.source, s.n, case when s.n = 0 then 0e0 when s.n / s.w < f.edge or (f.l * s.w / f.lw > 3 * s.n) then 3e0 * s.n else f.l * s.w / f.lw end as target from s left join f on true),
q as (select source, n, target, case when n > 0 then cast(round(target) as bigint) // n else 0 end as whole, case when n > 0 then cast(round(target) as bigint) % n else 0 end as rest from t),
c as (select d.*, q.n, q.target, q.whole, q.rest, sum(size) over (partition by d.source order by place) as upto from d join q on d.source is not distinct from q.source)
select doc_id, size::bigint as size, n as source_size, target::double as target, (size * (whole + case when rest > 0 and upto - size / 2 <= rest then 1 else 0 end))::bigint as taken from c"""

RULES = rf"""with d as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {SPACED}) as w from documents),
l as (select doc_id, x, row_number() over (partition by doc_id, x) as k from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
ln as (select doc_id, count(*) as n_lines, count(*) filter (k > 1) as n_dup from l group by doc_id),
g as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
rw as (select doc_id, count(distinct p) as n_repeat from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id),
s as (select d.doc_id, lang, source, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
 coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines from d left join ln using (doc_id) left join rw using (doc_id)),
v as (select doc_id, lang, source, unnest(['symbols', 'word_length', 'dup_lines', 'repeats']) as name, unnest([100, 500, 150, 100]) as spread,
 unnest([floor(n_symbols * 1000 / greatest(n_words, 1)), floor(word_chars * 1000 / greatest(n_words, 1)), floor(n_dup_lines * 1000 / greatest(n_lines, 1)), floor(n_repeat_words * 1000 / greatest(n_words, 1))])::bigint as v from s where n_words > 0),
h as (select *, greatest(floor(log2(v + 0.5)) - 5, 0)::int as sh from v),
b as (select lang, source, name, spread, sh * 1000 + (v >> sh) as bucket, sh, count(*) as n from h group by all),
u as (select *, sum(n) over (partition by lang, source, name order by bucket) as upto, sum(n) over (partition by lang, source, name) as total, (((v0 + 1) << sh) - 1) as hi_v from (select *, bucket % 1000 as v0 from b)),
q as (select lang, source, name, spread, min(case when upto >= total * 0.25 then hi_v end) as q1, min(case when upto >= total * 0.75 then hi_v end) as q3 from u group by all),
m as (select *, q3 + greatest(q3 - q1, spread) * 3e0 as hi, q1 - greatest(q3 - q1, spread) * 3e0 as lo from q),
bad as (select v.doc_id, bool_or(v.v > hi or (v.name = 'word_length' and v.v < lo)) as bad from v join m on v.name = m.name and v.lang is not distinct from m.lang and v.source is not distinct from m.source group by v.doc_id)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(bad, false) as kept from s left join bad using (doc_id)"""

NEAR = rf"""with recursive w as (select doc_id, regexp_extract_all({LOW}, {SPACED}) as w from documents),
sh as (select distinct doc_id, array_to_string(w[i : i + k - 1], ' ') as s from (select *, least(len(w), 4) as k from w where len(w) > 0), unnest(range(1, len(w) - k + 2)) as t(i)),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as inter from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * inter >= 80 * (na.n + nb.n - inter)),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, least(a, min(b)) as c from r group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.c, w.doc_id) as component_id, coalesce(c.c, w.doc_id) = w.doc_id as kept from w left join n using (doc_id) left join c using (doc_id)"""

HAN = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
SPANS = rf"""with d as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+$') as s from documents),
u as (select doc_id, len(s) as n, i, s[i] as s, regexp_replace(regexp_replace(s[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') as k, len(regexp_extract_all(s[i], {SPACED})) as w0,
 len(regexp_extract_all(s[i], '[{HAN}]|[^\x20\x09-\x0D{HAN}]+')) - case when i > 1 and regexp_matches(s[i], '^[^\x20\x09-\x0D{HAN}]') and regexp_matches(s[i - 1], '[^\x20\x09-\x0D{HAN}]$') then 1 else 0 end as w from d, unnest(range(1, len(s) + 1)) as t(i)),
y as (select *, sum(w) over (partition by doc_id order by i) as upto, sum(w) over (partition by doc_id order by i) - w as before from u),
l as (select doc_id, list(k order by i) as ks from u group by doc_id),
e as (select doc_id, upto, min(i) as j from y group by doc_id, upto),
r as (select a.doc_id, a.i, 3 - b.n as size from y a, (select unnest([0, 1, 2]) as n) b where a.i + 2 - b.n <= a.n),
z as (select r.doc_id, r.i, r.size, y.upto - x.before as w from r join y x on x.doc_id = r.doc_id and x.i = r.i join y on y.doc_id = r.doc_id and y.i = r.i + r.size - 1),
v as (select z.doc_id, z.i, y.before + 8 as want from z join y on y.doc_id = z.doc_id and y.i = z.i where z.size = 3 and z.w < 8),
p as (select doc_id, i, size from z where w >= case size when 3 then 8 else 30 end union all select v.doc_id, v.i, e.j - v.i + 1 from v asof join e on v.doc_id = e.doc_id and v.want <= e.upto),
g as (select p.doc_id, i, size, row_number() over (partition by size, array_to_string(ks[i : i + size - 1], chr(1)) order by p.doc_id, i) as rn from p join l on l.doc_id = p.doc_id),
x as (select distinct doc_id, unnest(range(i, i + size)) as i from g where rn > 1),
o as (select u.doc_id, string_agg(case when x.i is null then u.s end, '' order by u.i) as kept, count(x.i) as n_removed, coalesce(sum(case when x.i is not null then w0 end), 0)::bigint as words_removed from u left join x on x.doc_id = u.doc_id and x.i = u.i group by u.doc_id)
select d.doc_id, case when coalesce(n_removed, 0) = 0 then d.text else coalesce(kept, '') end as text, len(s)::bigint as n_sentences, coalesce(n_removed, 0)::bigint as n_removed, coalesce(words_removed, 0)::bigint as words_removed from d left join o using (doc_id)"""

LEAKS = rf"""with d as (select doc_id, {ALNUM} as w from documents),
b as (select cast(item_id as varchar) as item, w, least(len(w), 10) as k from (select item_id, {ALNUM} as w from benchmark where item_id is not null) where len(w) > 0),
bw as (select array_to_string(w[i : i + k - 1], ' ') as win, k, list(distinct item) as items from b, unnest(range(1, len(w) - k + 2)) as t(i) group by 1, 2),
dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as win from d, (select distinct k from bw) as ks, unnest(range(1, len(w) - k + 2)) as t(i)),
h as (select doc_id, i, k, items from dw join bw using (win, k)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by doc_id),
m as (select doc_id, list_sort(list(distinct item)) as ids from (select doc_id, unnest(items) as item from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, n_hit is not null as contaminated from d left join n using (doc_id) left join m using (doc_id)"""

#: Rules over all token sets of each page, so for small tables only.
URLS = r"""with u as (select page_id, coalesce(url, '') as url, contains(coalesce(url, ''), '://') as ok from pages),
r as (select *, case when ok then regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) else '' end as h0, case when ok then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from u),
d as (select row_number() over () as row, page_id, url, path, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from r),
w as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) as t(h, p, v)),
f as (select d.row, arg_max(w.h || w.p, len(w.h) + len(w.p)) as rule, arg_max(w.v, len(w.h) + len(w.p)) as v from d join w on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by d.row),
a as (select d.row, f.v is not null as known, coalesce(f.v = 'block', false) as bad, unnest(list_distinct(['scheme:' || regexp_extract(url, '^([A-Za-z]*)://', 1)]
 || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || case when regexp_matches(x, '^[0-9]+$') then '0' else x end)
 || list_transform(list_filter(regexp_split_to_array(lower(path), '[/._-]'), lambda x: x <> ''), lambda x: 'path:' || case when regexp_matches(x, '^[0-9]+$') then '0' else x end)
 || list_transform(list_filter(regexp_split_to_array(lower(regexp_extract(url, '(?s)\?([^#]*)', 1)), '[&=]'), lambda x: x <> ''), lambda x: 'query:' || case when regexp_matches(x, '^[0-9]+$') then '0' else x end))) as token from d left join f on d.row = f.row where host <> ''),
k as (select row, bad, token from a where known),
c as (select greatest(10, ceil(0.002 * count(distinct row))) as least from k),
e as (select token, list_sort(list(row)) as pages from k group by token having count(*) filter (bad) >= (select least from c)),
i as (select token, min(token) over (partition by pages) as item from e),
t as (select row, bad, known, list_sort(list(distinct item)) as items from a join i using (token) group by row, bad, known),
s as (select row, bad, list_filter(items, lambda x, n: (m >> (n - 1)) & 1 = 1) as s from (select *, unnest(range(1, 1 << len(items))) as m from t where known)),
q as (select s, count(*) filter (bad) / count(*) as conf from s group by s having count(*) filter (bad) >= (select least from c) and count(*) filter (bad) >= count(*) * 0.9e0),
g as (select s from q where not exists (select 1 from q as z where len(z.s) < len(q.s) and list_has_all(q.s, z.s) and z.conf >= q.conf)),
n as (select row, count(*) as n from t join g on list_has_all(t.items, g.s) group by row)
select page_id, host, path, rule, coalesce(v, case when n.n > 0 then 'block' else 'allow' end) as verdict, coalesce(n.n, 0)::bigint as n_matched from d left join f on d.row = f.row left join n on d.row = n.row"""

AUDIT = rf"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {SPACED}) as w from documents),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
 regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)] as bad from d left join l on d.doc_id = l.doc_id),
c as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
p as (select a.x || b.x || c.x || d.x || e.x as filter_order from c a join c b on b.x <> a.x join c on c.x not in (a.x, b.x) join c d on d.x not in (a.x, b.x, c.x) join c e on e.x not in (a.x, b.x, c.x, d.x)),
s as (select filter_order, step, ascii(filter_order[step]) - 64 as k, list_transform(range(1, step), lambda j: ascii(filter_order[j]) - 64) as ks from p, unnest(range(1, 6)) as t(step)),
r as (select part, filter_order, step, k, bad[k] as fails, len(list_filter(ks, lambda j: bad[j])) = 0 as there, len(list_filter(bad, lambda x: x)) as n_bad, good, toxic from f, s),
g as (select part, filter_order, step, k, count(*) filter (there and not fails) as kept, count(*) filter (there and fails) as removed, count(*) filter (fails and not there) as redundant, count(*) filter (fails and n_bad = 1) as unique_fails,
 count(*) filter (there and fails and good) as good_lost, count(*) filter (there and fails and toxic) as toxic_lost from r group by part, filter_order, step, k)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, k))::bigint as shapley from g"""

COPIES = rf"""with d as (select doc_id, {LOW} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256 from d"""


def _lloyd(rounds: int = 3) -> str:
    """Assignment and means unrolled, round by round."""
    out = """with v as (select row_number() over () as r, vec_id, embedding as e, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('1:' || vec_id), e) - 1 as c, v as m from v where vec_id is not null order by c limit 16)"""
    for i in range(rounds + 1):
        out += f""",
d{i} as (select r, c, v, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{i}),
a{i} as (select r, arg_min(c, d * 16 + c) as c, arg_min(v, d * 16 + c) as v, min(d) as d from d{i} group by r)"""
        if i < rounds:
            out += f""",
s{i} as (select c, j, sum(v[j])::bigint as s, count(*) as n from a{i}, unnest(range(1, 65)) as t(j) group by c, j),
m{i} as (select c, list((s - (s % n + n) % n) // n order by j) as m from s{i} group by c),
c{i + 1} as (select c{i}.c, coalesce(m{i}.m, c{i}.m) as m from c{i} left join m{i} on c{i}.c = m{i}.c)"""
    return f"""{out}
select vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c{rounds}.m, ',')) as centroid_sha256
from a{rounds} a join v on a.r = v.r join c{rounds} on a.c = c{rounds}.c"""


ORACLE_SQL = {"op2_source_mix": MIX, "op3_quality_rules": RULES, "op4_url_filter": URLS, "op5_near_dedup": NEAR, "op6_span_dedup": SPANS, "op10_decontaminate": LEAKS, "op11_filter_audit": AUDIT, "op12_exact_dedup": COPIES, "op13_lloyd_clusters": _lloyd()}
