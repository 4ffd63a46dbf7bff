"""DuckDB SQL for the text operators that SQL can express."""

_WS = r"[ \t\n\x0B\f\r]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^ \t\n\x0B\f\r]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
e as (select doc_id, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
k as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, k.b from r join k on r.b = k.a)
select s.doc_id, len(s.s) as n_shingles, min(r.b) as component_id from s join r on r.a = s.doc_id group by all
"""

REPEATS = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, (2 * i + 1)::bigint, 400)) as m from (select doc_id, h, unnest(range(0, length(h) // 2 - 199)) as i from h where length(h) >= 400)),
hit as (select doc_id, i from (select *, count(*) over (partition by m) as n from w) where n > 1),
run as (select doc_id, i, i - 200 - max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as gap from hit),
isl as (select doc_id, i, sum((gap is null or gap > 0)::int) over (partition by doc_id order by i) as g from run),
iv as (select doc_id, g, min(i) as lo, max(i) + 200 as hi from isl group by all),
cut as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as before from iv),
agg as (select c.doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, string_agg(substr(h, (2 * before + 1)::bigint, (2 * (lo - before))::bigint), '' order by lo) as head, max(hi) as tail from cut c join h on h.doc_id = c.doc_id group by c.doc_id)
select h.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
 sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(tail, 0) + 1)::bigint))) as kept_sha256 from h left join agg on agg.doc_id = h.doc_id
"""

_DIV = "case when p > 0 then p * log2(2 * p / (p + q)) else 0 end / 2 + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end / 2"
_CLASS = ["[^a-z]", "[^A-Z]", "[^0-9]", r"[^.,;:!?''\"()-]", r"[^#-&*+/<->@\[-`{-~]", r"[\x21-\x7E]"]
_COUNTS = ", ".join(f"length(regexp_replace(r0, '{c}', '', 'g'))" for c in _CLASS)

DIVERGENCE = rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t from documents),
b as (select *, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') as ws, regexp_replace(t, '{_WS}+', '', 'g') as r0 from d),
c as (select *, list_value({_COUNTS}, length(t) - length(r0)) as cl, len(ws) as n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as ls from b),
ln as (select lang, sum(n) as n from c group by 1),
kl as (select lang, case when n >= 200 then 'l' || lang else '*' end as key from ln),
lc as (select key, i, sum(cl[i])::double as s from (select 'l' || lang as key, cl, unnest(range(1, 8)) as i from c union all select '*', cl, unnest(range(1, 8)) from c) group by all),
cq as (select key, i, s / greatest(sum(s) over (partition by key), 1) as q from lc),
kn as (select 'l' || lang as key, n from ln union all select '*', sum(n) from ln),
sl as (select lang, w, count(*) as k from (select lang, unnest(regexp_extract_all(lower(t), '[^ \t\n\x0B\f\r]+')) as w from d) where length(w) <= 64 group by all),
sw as (select 'l' || lang as key, w, k from sl union all select '*', w, sum(k) from sl group by w),
tw as (select key, w, k from sw qualify row_number() over (partition by key order by k desc, w) <= 40),
wq as (select tw.key, w, k::double / kn.n as q from tw join kn on tw.key = kn.key),
oq as (select kn.key, greatest(0, 1 - coalesce(sum(q), 0)) as q from kn left join wq on wq.key = kn.key group by all),
dc as (select doc_id, sqrt(greatest(0, sum({_DIV}))) as jc from (select doc_id, cl[cq.i]::double / greatest(list_sum(cl), 1) as p, cq.q from c join kl on kl.lang = c.lang join cq on kl.key = cq.key) group by 1),
dw as (select doc_id, key, unnest(list_transform(ws, lambda x: lower(x))) as w, n from c join kl on kl.lang = c.lang),
bins as (select dw.doc_id, wq.w is null as other, wq.w, any_value(coalesce(wq.q, oq.q)) as q, count(*)::double / any_value(n) as p from dw left join wq on wq.key = dw.key and wq.w = dw.w join oq on oq.key = dw.key group by dw.doc_id, other, wq.w),
jw as (select doc_id, sqrt(greatest(0, 0.5 + sum({_DIV} - q / 2))) as jw from bins group by 1),
g as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as x from (select doc_id, ws, unnest(range(1, n - 6)) as i from c where n >= 8)),
rep as (select doc_id, count(distinct i + o) as r from (select doc_id, i, count(*) over (partition by doc_id, x) as k from g), (select unnest(range(8)) as o) where k > 1 group by 1),
o as (select c.doc_id, n, length(r0) as wc, length(r0) - length(regexp_replace(r0, '[#*$%&|<>]', '', 'g')) as sy, len(ls) - len(list_distinct(ls)) as dl, coalesce(r, 0) as rw, jc, coalesce(jw, 0) as jw
 from c join dc on dc.doc_id = c.doc_id left join jw on jw.doc_id = c.doc_id left join rep on rep.doc_id = c.doc_id)
select doc_id, n::bigint as n_words, wc::bigint as word_chars, sy::bigint as n_symbols, dl::bigint as n_dup_lines, rw::bigint as n_repeat_words, (n < 20 or 100 * rw > 30 * n) as base_failed,
 (not (n < 20 or 100 * rw > 30 * n) and (n < 50 or (jc <= 0.30 and jw <= 0.43))) as kept, round(jc, 6)::double as char_distance, round(jw, 6)::double as word_distance from o
"""

_PARTS = "array_to_string(u[{}:{}], '')"

FILL_MIDDLE = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as h from documents),
h as (select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as a, ('0x' || h[9:16])::bigint % (len(u) + 1) as b, ('0x' || h[17:24])::bigint % 100 as c, ('0x' || h[25:32])::bigint % 100 as e from d),
p as (select doc_id, n, text, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c >= 90 then 'plain' when e < 20 then 'spm' else 'psm' end as form,
 {_PARTS.format(1, "least(a, b)")} as x, {_PARTS.format("least(a, b) + 1", "greatest(a, b)")} as m, {_PARTS.format("greatest(a, b) + 1", "n")} as s from h),
o as (select *, case form when 'plain' then text when 'psm' then '<P>' || x || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || x || '<M>' || m end as out from p),
r as (select *, case form when 'plain' then out
 when 'psm' then out[4:instr(out, '<S>') - 1] || out[instr(out, '<M>') + 3:] || out[instr(out, '<S>') + 3:instr(out, '<M>') - 1]
 else out[instr(out, '<P>') + 3:instr(out, '<M>') - 1] || out[instr(out, '<M>') + 3:] || out[4:instr(out, '<P>') - 1] end as again from o)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(x) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
 sha256(out) as output_sha256, sha256(again) as restored_sha256 from r
"""

HARD_NEGATIVES = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select p.*, s.other as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other)::int as rank
 from p join s on s.anchor_id = p.anchor_id where not same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

MINHASH = f"select *, doc_id = component_id as kept from ({JACCARD.replace('80 *', '85 *')})"
