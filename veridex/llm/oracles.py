"""The contract queries in DuckDB SQL, where SQL can say them: plain brute force over all windows and pairs."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Bytes as pairs of hex digits; islands of overlapping or touching windows are the removed runs.
OP3 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents), p as (select doc_id, unnest(generate_series(1, length(x) // 2 - 399)) as i, x from d where length(x) >= 800),
h as (select doc_id, i, md5(substr(x, 2 * i - 1, 800)) as h from p), r as (select h from h group by 1 having count(*) > 1), s as (select doc_id, i from h semi join r using (h)),
g as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end as new from s), k as (select *, sum(new) over (partition by doc_id order by i rows unbounded preceding) as island from g),
e as (select doc_id, island, min(i) as a, max(i) + 400 as b from k group by 1, 2), f as (select *, coalesce(lag(b) over (partition by doc_id order by a), 1) as before, row_number() over (partition by doc_id order by a desc) as last from e),
c as (select f.doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed, string_agg(substr(x, 2 * before - 1, 2 * (a - before)), '' order by a) || substr(any_value(x), 2 * max(b) - 1) as kept from f join d using (doc_id) group by 1)
select doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from d left join c using (doc_id)"""

OP4 = f"""with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s), p as (select a.doc_id as u, b.doc_id as v, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from p where 100 * c >= 75 * (na + nb - c)), b as (select u, v from l union select v, u from l), r(node, reach) as (select u, u from b union select r.node, b.v from r join b on b.u = r.reach),
c as (select node, min(reach) as component_id from r group by 1)
select s.doc_id, len(s.s) as n_shingles, coalesce(c.component_id, s.doc_id) as component_id from s left join c on c.node = s.doc_id"""

OP5 = f"""with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents), p as (select doc_id, unnest(generate_series(1, len(w) - 49)) as i, w from d where len(w) >= 50),
h as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from p), f as (select h, min(doc_id) as first from h group by 1), s as (select doc_id, i from h join f using (h) where first < doc_id),
g as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from s), k as (select *, sum(new) over (partition by doc_id order by i rows unbounded preceding) as island from g),
e as (select doc_id, island, min(i) as a, max(i) + 50 as b from k group by 1, 2), t as (select doc_id, list({{'a': a, 'b': b}} order by a) as t, sum(b - a)::bigint as n_removed from e group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(array_to_string(case when t is null then w else list_filter(w, lambda x, j: len(list_filter(t, lambda y: y.a <= j and j < y.b)) = 0) end, ' ')) as kept_sha256 from d left join t using (doc_id)"""

_NORM = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

OP10 = f"""with d as (select doc_id, {_NORM} as w from documents), b as (select item_id, {_NORM} as v from benchmark), ig as (select item_id, i, array_to_string(v[i:i + 4], ' ') as g from (select item_id, v, unnest(generate_series(1, len(v) - 4)) as i from b where len(v) >= 5)),
dg as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from d where len(w) >= 5)),
st as (select distinct dg.doc_id, ig.item_id, greatest(0, least(dg.i - ig.i, len(d.w) - len(b.v))) as s from dg join ig using (g) join d on d.doc_id = dg.doc_id join b on b.item_id = ig.item_id),
x as (select doc_id, item_id, s, len(w[s + 1:s + len(v)]) as n, w[s + 1:s + len(v)] as a, v from st join d using (doc_id) join b using (item_id)),
y as (select *, case when n < 5 then [array_to_string(a, ' ')] else list_transform(generate_series(1, n - 4), lambda i: array_to_string(a[i:i + 4], ' ')) end as ga, list_transform(generate_series(1, len(v) - 4), lambda i: array_to_string(v[i:i + 4], ' ')) as gb from x),
z as (select *, list_sum(list_transform(list_intersect(ga, gb), lambda k: least(len(list_filter(ga, lambda q: q = k)), len(list_filter(gb, lambda q: q = k))))) as shared from y),
m as (select doc_id, item_id, s, n, round(coalesce(shared, 0)::double / (len(ga) + len(gb) - coalesce(shared, 0)), 6) as similarity from z), r as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, s) as r from m where similarity >= 0.75)
select doc_id, item_id, similarity, s as start, n as n_words from r where r = 1"""

#: The CRC table is built by its rule; near words are found by all their deletions.
OP11 = r"""with recursive crc as (select list(x order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as x from range(256) r(i))),
runs as (select doc_id, run, count(*) as times from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) group by all),
coded as (select run, times, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195, ord(c)::bigint - 64] end)) as bytes from runs),
hashed as (select run, times, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) as h from coded, crc),
w as (select word, sum(times)::bigint as n from (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from hashed) where length(word) >= 5 group by 1 having sum(times) >= 3),
d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(generate_series(1, length(word))) as i from w)),
p as (select distinct a.word, b.word as other, b.n as m from d a join d b on a.i = b.i and a.rest = b.rest and a.word <> b.word union select d.word, w.word, w.n from d join w on d.rest = w.word union select w.word, d.word, d.n from d join w on d.rest = w.word),
f as (select word, n, count(other) as n_near, first(other order by m desc, other) as other, max(m) as m from w left join p using (word) group by 1, 2),
g as (select word, n, n_near, case when m >= 2 * n then other end as form, case when m >= 2 * n then m end as form_n from f),
r as (select word, word as root, 0 as step from g union all select r.word, g.form, step + 1 from r join g on g.word = r.root where g.form is not null)
select g.word, form, root, n, n_near, form_n from g join (select word, arg_max(root, step) as root from r group by 1) using (word)"""
