"""SQL twins of corpus queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


CONTAMINATION = rf"""
with d as (select doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as w from documents),
b as (select cast(item_id as varchar) as item, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as w from benchmark),
i as (select item, w, least(10, len(w)) as m from b where len(w) > 0),
x as (select item, m, w[k : k + m - 1] as win from (select *, unnest(range(1, len(w) - m + 2)) as k from i)),
l as (select distinct m from x),
y as (select doc_id, k, m, w[k : k + m - 1] as win from (select *, unnest(range(1, len(w) - m + 2)) as k from d, l where len(w) >= m)),
h as (select distinct doc_id, k, y.m, item from y join x on y.m = x.m and y.win = x.win),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + m)) as p from h) group by doc_id),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from h group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""

ARCHIVE = """
with p as (select page_id, coalesce(html, '') as h from pages),
r as (select page_id, h, max(page_id) over (partition by h) as head, sha1(h) as hex from p)
select page_id, strlen(h) as payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  cast(1 + ((cast('0x' || substr(hex, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as bigint), 1)), '') as payload_digest,
case when page_id = head then 'response' else 'revisit' end as record_type,
case when page_id = head then null else head end as refers_to, true as intact
from r
"""

COMPONENTS = rf"""
with recursive d as (select doc_id, {_words(r"[^\x20\x09-\x0D]+")} as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from d),
g as (select min(doc_id) as node, list_sort(s) as k from s where len(s) > 0 group by list_sort(s)),
e as (select node, len(k) as n, unnest(k) as x from g),
c as (select a.node as u, b.node as v, a.n as n, b.n as m, count(*) as q from e a join e b on a.x = b.x and a.node < b.node group by all),
l as (select u, v from c where 100 * q >= 75 * (n + m - q)),
f as (select u, v from l union select v, u from l),
r as (select node, node as far from g union select r.node, f.v from r join f on r.far = f.u),
z as (select node, min(far) as component_id from r group by node)
select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id,
coalesce(component_id, doc_id) = doc_id as kept
from s left join g on len(s) > 0 and list_sort(s) = k left join z using (node)
"""

PHRASES = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
p as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
t as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang),
g as (select lang, m, w[k : k + m - 1] as g from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as k
  from p, (select unnest(range(1, 6)) as m) where len(w) >= m)),
f as (select lang, m, g, count(*) as a from g group by all having count(*) >= 100),
c as (select f.lang, f.m, f.g, f.a, k from f, (select unnest(range(1, 5)) as k) where k < f.m),
s as (select c.lang, c.m, c.g, c.a, c.k, x.a as l, y.a as r, t.n,
  cast((cast(1000 as hugeint) * c.a * t.n) // (cast(x.a as hugeint) * y.a) as bigint) as score
  from c join t using (lang) join f x on x.lang = c.lang and x.g = c.g[1 : c.k] join f y on y.lang = c.lang and y.g = c.g[c.k + 1 : c.m]),
b as (select * from s qualify row_number() over (partition by lang, g order by score, k) = 1),
i as (select distinct f.lang, f.g[j : j + h - 1] as g, f.a from f, (select unnest(range(2, 5)) as h), (select unnest(range(1, 5)) as j)
  where h < f.m and j + h - 1 <= f.m),
k as (select b.* from b where not exists (select 1 from i where i.lang = b.lang and i.g = b.g and i.a >= b.a)),
z as (select lang, cast(row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(g, ' '))) as bigint) as rank,
  array_to_string(g, ' ') as phrase, a, l, r, n, score from k)
select * from z where rank <= 2000
"""

REPEATS = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, k, array_to_string(w[k : k + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as k from d where len(w) >= 20)),
r as (select doc_id, k from x qualify row_number() over (partition by g order by doc_id, k) > 1),
c as (select distinct doc_id, p from (select doc_id, unnest(range(k, k + 20)) as p from r)),
e as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
s as (select e.doc_id, count(*) as n, string_agg(w[p], ' ' order by p) as t from e left join c using (doc_id, p) where c.p is null group by e.doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join s using (doc_id)
"""
