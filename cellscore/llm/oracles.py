"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import string

from cellscore.llm.negatives import ORACLE as HARD_NEGATIVES

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SYMBOL_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACE_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

JACCARD = f"""
with recursive w as (select doc_id, {SPACE_WORDS} as w from documents),
s as (
 select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i : i + 3], 'string_agg', ' '))
   when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end) as g
 from w),
z as (select doc_id, count(g) as n from w left join s using (doc_id) group by 1),
e as (
 select x, y from (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2)
 join z p on p.doc_id = x join z q on q.doc_id = y where 100 * i >= 85 * (p.n + q.n - i)),
reach(id, label) using key (id) as (
 select doc_id, doc_id from z
 union
 select e.y, min(r.label) from reach r join e on e.x = r.id join recurring.reach k on k.id = e.y where r.label < k.label group by e.y)
select doc_id, n as n_shingles, label as component_id from z join reach on id = doc_id
"""

DECONTAMINATION = f"""
with b as (select item_id, {SYMBOL_WORDS} as w from benchmark),
i as (
 select distinct item_id, least(len(w), 13) as n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda k: list_aggregate(w[k : k + least(len(w), 13) - 1], 'string_agg', ' '))) as g
 from b where len(w) > 0),
d as (select doc_id, {SYMBOL_WORDS} as w from documents),
v as (
 select doc_id, n, unnest(range(1, len(w) - n + 2)) as p, unnest(list_transform(range(1, len(w) - n + 2), lambda k: list_aggregate(w[k : k + n - 1], 'string_agg', ' '))) as g
 from d, (select distinct n from i) where len(w) >= n),
o as (select doc_id, item_id, n, p from v join i using (n, g)),
h as (select doc_id, count(distinct p + k) as n_hit from (select doc_id, p, unnest(range(n)) as k from o) group by 1),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from o group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
 coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

EXACT = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by k) as group_size, doc_id = first_value(doc_id) over w as kept, sha256(k) as text_sha256
from d window w as (partition by k order by length(t) desc, doc_id)
"""

ORACLES = {
    "op7_ngram_jaccard_join": JACCARD,
    "op8_benchmark_decontamination": DECONTAMINATION,
    "op10_exact_dedup": EXACT,
    "op12_hard_negatives": HARD_NEGATIVES,
}
