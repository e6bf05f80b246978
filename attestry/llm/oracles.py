"""DuckDB statements for the queries that plain SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Added characters of the template's escapes: one for each backslash and control string.
_ESCAPED = r"len({0}) + len(regexp_extract_all({0}, '\\|<s>|</s>|\[INST\]|\[/INST\]|\[\|\]'))"

OP1 = f"""
with c as (
  select conv_id, turn, role r, text t, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, r nulls first, t nulls first) i from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) turns_sha256,
  cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(case when role = 'assistant' then 10 else 16 end + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) as bigint) formatted_chars
from n group by conv_id
"""

OP3 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) h from (select doc_id, ws, unnest(range(1, len(ws) - 33)) i from w where len(ws) >= 35)),
again as (select h from g group by h having count(*) > 1),
cut as (select distinct doc_id, unnest(range(i, i + 35)) p from g where h in (select h from again)),
each as (select doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) p from w),
k as (select e.doc_id, count(*) filter (c.p is not null) n_removed, string_agg(word, ' ' order by e.p) filter (c.p is null) kept from each e left join cut c on e.doc_id = c.doc_id and e.p = c.p group by 1)
select doc_id, len(ws) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k using (doc_id)
"""

OP5 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end s from w),
t as (select doc_id, len(s) n, unnest(s) x from s),
p as (select a.doc_id a, b.doc_id b, any_value(a.n) n, any_value(b.n) m, count(*) c from t a join t b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 90 * (n + m - c) union all select b, a from p where 100 * c >= 90 * (n + m - c)),
r as (select a id, a root from l union select l.b, r.root from r join l on l.a = r.id)
select s.doc_id, len(s.s) n_shingles, coalesce((select min(root) from r where r.id = s.doc_id), s.doc_id) component_id from s
"""

OP7 = rf"""
with w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id, ws, least(10, len(ws)) k from (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark) where len(ws) > 0),
v as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') x from (select *, unnest(range(1, len(ws) - k + 2)) i from b)),
d as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') x from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) i from w, (select distinct k from b) where len(ws) >= k)),
h as (select doc_id, item_id, i, d.k from d join v on d.k = v.k and d.x = v.x),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from h) group by 1),
m as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, cast(item_id as varchar) item_id from h) group by 1)
select doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from w left join n using (doc_id) left join m using (doc_id)
"""

OP8 = """
with recursive v as (select vec_id, label, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings where label is not null and embedding is not null),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where a.n > 0 and b.n > 0 and list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
c as (select a, count(*) n from l group by 1), r as (select a id, a root from l union select l.b, r.root from r join l on l.a = r.id), m as (select id, min(root) root from r group by id)
select vec_id, coalesce(c.n, 0) n_links, coalesce(m.root, vec_id) component_id, coalesce(m.root, vec_id) = vec_id kept from embeddings left join c on c.a = vec_id left join m on m.id = vec_id
"""

#: CRC-32 of the text {0}; {1} is the list of the remainders of all bytes.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex({0})) // 2), lambda k: cast('0x' || substr(hex({0}), 2 * k + 1, 2) as bigint))), lambda c, y: xor(c >> 8, {1}[1 + (xor(c, y) & 255)])), 4294967295)"
_CRC_TABLE = "(select list(v order by i) from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from (select unnest(range(256)) i)))"

OP11 = f"""
with h as (select c, {_CRC32.format("cast(c as varchar)", "t")} % 9 h from (select distinct conv_id c, {_CRC_TABLE} t from conversations where conv_id is not null)),
o as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) p from conversations where conv_id is not null),
u as (select h.c, p, r, x, 0 part from h join o on o.c = h.c - h.c % 5 where p <= h union all select h.c, p, r, x, 1 from h join o on o.c = h.c where p > h),
s as (select c, row_number() over (partition by c order by part, p) d, strlen(x) z, length(r) || ':' || r || length(x) || ':' || x y from u),
q as (select c, d, z, string_agg(y, '' order by d) over (partition by c order by d) k, string_agg(y, '' order by d) over (partition by c order by d rows between unbounded preceding and 1 preceding) pk from s union all select c, 0, 0, '', null from h),
m as (select c, max(d) n from q group by 1),
n as (select k, any_value(d) d, any_value(z) z, any_value(coalesce(pk, '')) pk, min(c) c, count(*) n_convs, string_agg(cast(c as varchar), ',' order by c) filter (d = n) ends from q join m using (c) group by k),
w as (select n.*, (select count(*) from n i where i.pk = n.k and i.d = n.d + 1) n_children from n),
f as (select q.k, any_value(w.n_convs) n_convs, any_value(w.z) z, any_value(w.n_children) n_children from q join q q2 on q.c = q2.c and q2.d >= q.d join w on w.k = q2.k group by q.k, w.k),
g as (select k, count(*) filter (n_children = 0) n_leaves, cast(sum((n_convs - 1) * z) as bigint) saved_tokens from f group by k)
select w.c conv_id, w.d depth, p.c parent_conv_id, w.n_convs, w.n_children, g.n_leaves, g.saved_tokens, sha256(coalesce(w.ends, '')) ends_sha256
from w join g using (k) left join w p on p.k = w.pk and w.d = p.d + 1
"""

OP13 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
e as (select doc_id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) f from d),
g as (select unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) f from b),
x as (select f, {_CRC32.format("f", "t")} % 10000 k from (select f, {_CRC_TABLE} t from (select f from e union select f from g))),
s as (select k, count(*) n from e join x using (f) group by 1), t as (select k, count(*) n from g join x using (f) group by 1),
w as (select k, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * (coalesce((select sum(n) from t), 0) + 10000)::double))) as bigint) gain from s left join t using (k)),
m as (select doc_id, count(*) n, cast(sum(gain) as bigint) z from e join x using (f) join w using (k) group by 1),
v as (select doc_id, len(ws) words, coalesce(n, 0) n_features, coalesce((z - ((z % n) + n) % n) // n, 0) weight from d left join m using (doc_id)),
c as (select *, weight + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) score from v),
r as (select doc_id, row_number() over (order by score desc, doc_id) rank, count(*) over () n from c where words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * r.n // 100 then rank end rank from c left join r using (doc_id)
"""

SQL = {
    "op1_chat_formatting": OP1,
    "op3_substring_dedup": OP3,
    "op5_ngram_jaccard_join": OP5,
    "op7_benchmark_decontamination": OP7,
    "op8_embedding_near_dedup": OP8,
    "op11_conversation_prefix_trie": OP11,
    "op13_importance_resampling": OP13,
}
