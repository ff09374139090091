"""DuckDB SQL for the queries that it can express over whole tables.

The other queries are held against brute force in the tests: SQL has no mixture
model, keyed surrogate, tokenizer, base-32 digest or sliding entropy window.
"""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: component_id of each node of links(u, v), which holds both directions.
_REACH = """
reach as (
  select u as node, v as other from links
  union
  select r.node, l.v from reach r join links l on l.u = r.other
),
least as (select node, min(other) as other from reach group by node)
"""

EMBEDDINGS = f"""
with recursive vectors as (
  select vec_id, embedding::double[] as e,
         sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding::double[], lambda x: x is null or isnan(x) or isinf(x))) = 0
),
links as (
  select a.vec_id as u, b.vec_id as v from vectors a join vectors b
  on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0
  and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
),
counts as (select u, count(*) as n from links group by u),
{_REACH}
select m.vec_id, coalesce(c.n, 0)::bigint as n_links,
       least(m.vec_id, coalesce(l.other, m.vec_id)) as component_id,
       m.vec_id = least(m.vec_id, coalesce(l.other, m.vec_id)) as kept
from embeddings m left join counts c on c.u = m.vec_id left join least l on l.node = m.vec_id
"""

REPEATS = rf"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i : i + 12], ' ') as window_text
  from words, unnest(range(1, len(w) - 11)) t(i)
),
firsts as (select window_text, min(doc_id) as first_id from windows group by window_text),
gone as (
  select distinct doc_id, i + k as p
  from windows join firsts using (window_text), range(13) t(k) where doc_id > first_id
),
places as (select doc_id, list(p) as ps from gone group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
       sha256(array_to_string(list_transform(
         list_filter(range(1, len(w) + 1), lambda i: not list_contains(coalesce(ps, []), i)), lambda i: w[i]), ' ')) as kept_sha256
from words left join places using (doc_id)
"""

OVERLAPS = rf"""
with words as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
items as (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from benchmark),
item_windows as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as window_text
  from items, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) where len(w) > 0
),
sizes as (select distinct size from item_windows),
doc_windows as (
  select doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') as window_text
  from words, sizes, unnest(range(1, len(w) - size + 2)) t(i)
),
found as (select doc_id, i, size, item_id from doc_windows join item_windows using (size, window_text)),
hits as (select doc_id, count(distinct i + k)::bigint as n from found, unnest(range(size)) t(k) group by doc_id),
names as (
  select doc_id, count(*)::bigint as n, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(m.n, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from words left join hits h using (doc_id) left join names m using (doc_id)
"""

NEAR = rf"""
with recursive words as (select doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as s
  from words, unnest(range(1, greatest(len(w) - 1, 2))) t(i) where len(w) > 0
),
sizes as (select doc_id, count(*)::bigint as n from shingles group by doc_id),
common as (
  select a.doc_id as u, b.doc_id as v, count(*) as n
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
),
links as (
  select u, v from common c join sizes a on a.doc_id = u join sizes b on b.doc_id = v
  where 100 * c.n >= 85 * (a.n + b.n - c.n)
),
{_REACH}
select doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(doc_id, coalesce(l.other, doc_id)) as component_id,
       doc_id = least(doc_id, coalesce(l.other, doc_id)) as kept
from words left join sizes s using (doc_id) left join least l on l.node = doc_id
"""

DIVERGENCE = rf"""
with rows as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
),
words as (select r, lang, source, unnest(w) as term from rows),
kept as (select lang, term from words group by lang, term having count(distinct r) >= 30),
sizes as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from rows),
counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by lang, source, term),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as own,
         sum(coalesce(c.n, 0)) over (partition by g.lang, k.term) as everywhere, sum(coalesce(c.n, 0)) over (partition by g.lang) as total, v
  from groups g join kept k using (lang) join sizes using (lang) left join counts c on (c.lang, c.source, c.term) = (g.lang, g.source, k.term)
),
shares as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (own + 5 * v) as p, 1 + (1000000000::hugeint * (everywhere + 5)) // (total + 5 * v) as q
  from cells
),
apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join apart x on (x.lang, x.source, x.item) = (a.lang, a.source, b.source)
  union all
  select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q
),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""

#: unsigned crc32 of a word's UTF-8 bytes: the table of 256 remainders by its rule, then one step a byte.
_CRC = """
crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
  from range(256) r(i)
),
crcs as (
  select w, xor(list_reduce(
    list_transform(range(1, octet_length(encode(w)) + 1), lambda k: ('0x' || substr(hex(encode(w)), (2 * k - 1)::int, 2))::bigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket
  from (select distinct w from (select w from doc_words union all select w from item_words)), crc_table
)
"""

IMPORTANCE = rf"""
with rows as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as words from documents),
doc_words as (select r, unnest(words) as w from rows),
item_words as (select unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) as w from benchmark),
{_CRC},
s as (select bucket, count(*) as s from doc_words join crcs using (w) group by bucket),
t as (select bucket, count(*) as t from item_words join crcs using (w) group by bucket),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from doc_words) + 10000)::double
    / ((coalesce(s, 0) + 1)::double * ((select count(*) from item_words) + 10000)::double)))::bigint as gain
  from s full join t using (bucket)
),
weights as (select r, sum(gain)::bigint as weight from doc_words join crcs using (w) join gains using (bucket) group by r),
scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296::double)))::bigint as score
  from rows left join weights using (r)
),
ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, (select count(*) from scored where n_features >= 20) as n from scored
)
select doc_id, n_features, weight, score::bigint as score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from ranked
"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": EMBEDDINGS,
    "op4_substring_dedup": REPEATS,
    "op7_benchmark_decontamination": OVERLAPS,
    "op9_minhash_near_dedup": NEAR,
    "op11_source_divergence": DIVERGENCE,
    "op13_importance_resampling": IMPORTANCE,
}
