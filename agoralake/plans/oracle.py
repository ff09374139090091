"""DuckDB SQL for the registered queries, written from their definitions, not from the Spark plans."""

from __future__ import annotations

import re

from ..functions import rules, text
from ..functions.keywords import alternatives
from .catalogue import ALLOWED_EVENTS, AS_OF, PHRASES, FEED_AS_OF, PRIORITIES, SELECTION


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def html_text(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '<br\s*/?>', ' — ', 'g'), '<[^>]+>', '', 'g')"
    for name, value in text.SQL_ENTITIES:
        x = f"replace({x}, {lit(name)}, {lit(value)})"
    return squeeze(f"replace({x}, chr(160), ' ')")


def found(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {lit(f'(?{flags})' + pattern if flags else pattern)})"


def bounded(pattern: str) -> str:
    """The pattern with word bounds of all scripts written out (they stand at the ends of alternatives)."""
    other = r"[^\p{L}\p{N}_]"
    ends = [re.sub(r"\\b$", lambda _: f"(?:$|{other})", re.sub(r"^\\b", lambda _: f"(?:^|{other})", a)) for a in alternatives(pattern)]
    return "|".join(ends)


def some(x: str, patterns, flags: str = "i") -> str:
    return "(" + " or ".join(found(x, p, flags) for p in patterns) + ")"


def plain_title(x: str) -> str:
    for p in text.TITLE_REMOVALS:
        x = f"regexp_replace({x}, {lit('(?i)' + p)}, ' ', 'g')"
    return x


PAGES = r"""
with p as (select page_id, url, html, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) as source, regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) as number,
  regexp_extract(url, '^https?://([^/?#]+)', 1) as body, TITLE as title,
  '2026-' || lpad(cast(page_id % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(page_id % 28 + 1 as varchar), 2, '0') as date_iso, page_id % 3 = 0 as decided from pages),
i as (select *, source || ':' || page_id || '#Ö 1' as ref, case when number <> '' then source || ':vorlage:' || number end as topic_key from p),
t as (select *, coalesce(topic_key, ref) as topic from i)
""".replace("TITLE", html_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))

LEAD = ", l as (select * from (select *, row_number() over (partition by topic order by decided desc, date_iso desc, page_id) as r from t) where r = 1)"

LINKS = r"""with h as (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages),
e as (select page_id, url, unnest(l) as href, unnest(range(len(l))) as pos from h),
k as (select page_id, url, href, min(pos) as pos from e group by all)"""

STATUS = f"""
with c as (select l_orderkey,
  max(case when l_returnflag = 'R' then l_shipdate end) as decision, max(case when l_returnflag = 'A' then l_shipdate end) as before,
  max(case when l_returnflag not in ('R', 'A') and l_linestatus = 'O' then l_shipdate end) as notice, max(l_shipdate) as last from lineitem group by 1),
s as (select o_orderkey, case when o_orderstatus = 'P' or last is null then 'Ohne Vorlage'
  when decision is not null then case when strftime(decision, '%Y-%m-%d') <= '{AS_OF}' then 'Entscheidung angesetzt' else 'Entscheidung geplant' end
  when before is not null then 'Wird noch beraten' when notice is not null then 'Bekanntgabe' else 'Anhörung' end as status,
  case when o_orderstatus = 'P' or last is null then '' else strftime(coalesce(decision, before, notice, last), '%d.%m.%Y') end as status_date
  from orders left join c on o_orderkey = l_orderkey)
"""

IN_SELECTION = f"p_brand in ({', '.join(map(lit, SELECTION['p_brand']))}) and p_size in ({', '.join(map(str, SELECTION['p_size']))})"

_heads = {s: f"trim(split_part(t, {lit(s)}, 1), ' ;,–—-')" for s in text.TITLE_SEPARATORS}
_cut = "case " + " ".join(f"when contains(t, {lit(s)}) and length({h}) >= {text.LEAST_HEAD} then {h}" for s, h in _heads.items()) + " else t end"
_scrub = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, {lit('(?is)' + text.SPEAKER)}, '', 'g'), {lit(text.TITLED_NAME)}, '', 'g'), '^\s+|\s+$', '', 'g')"

BUILT = PAGES + f""", l as (select * from (select *, row_number() over (partition by topic order by decided desc, date_iso desc, page_id) as r, count(*) over (partition by topic) as appearances from t) where r = 1),
b as (select * from (select *, min(page_id) over (partition by topic) as topic_ord, row_number() over (partition by topic order by page_id % 2 = 0, page_id % 5 = 0 desc, page_id % 3 desc, page_id) as r from t where source <> 'es') where r = 1),
m as (select url, max(page_id) as page_id from p where page_id % 4 = 0 group by 1),
f as (select b.topic, b.ref, b.page_id as best_id, b.source, b.topic_ord, b.page_id % 2 = 0 as is_draft, l.date_iso, l.title as official_title,
  case when l.number = '' or not l.decided then 'Ohne Vorlage' when l.date_iso <= '{FEED_AS_OF}' then 'Entscheidung angesetzt' else 'Entscheidung geplant' end as status,
  case when l.number = '' or not l.decided then '' else right(l.date_iso, 2) || '.' || substr(l.date_iso, 6, 2) || '.2026' end as status_date,
  coalesce('m' || m.page_id, '') as minutes_url, l.appearances as n_appearances from b join l using (topic) left join m on m.url = l.url)
"""

LOST = """with c as (select doc_id, lang, source, lang || '/' || source as topic from labels join documents using (doc_id) where quality = 1), f as (select * from c where {shown}),
l as (select * from c where not ({shown}))
select 'loss' as "check", 'error' as severity, doc_id as ref, cast(doc_id as varchar) as detail, 'strict' as variant from l where topic not in (select topic from f)
union all select 'loss', 'error', doc_id, cast(doc_id as varchar), 'as written' from l where not exists (select 1 from f)"""

ORACLE_SQL: dict[str, str] = {
    "flagship": PAGES + LEAD + r""", g as (select *, concat_ws(',', case when regexp_matches(title, '(?i)th') then 'th' end, case when regexp_matches(title, '(?i)on') then 'on' end, case when regexp_matches(title, '(?i)é') then 'é' end) as tags from l)
select topic, date_iso, page_id, tags from g where tags like '%th%' or tags like '%on%' order by date_iso desc, page_id limit 8""",
    "html_text": "select page_id, " + html_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + " as title, " + html_text("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)") + " as heading, sha256(" + html_text("regexp_extract(html, '(?s)<body>(.*)</body>', 1)") + ") as body_sha256 from pages",
    "link_extract": LINKS + " select page_id, pos, href from k",
    "url_absolutize": LINKS + " select page_id, pos, case when starts_with(href, 'http') then href else regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || ltrim(href, '/') end as absolute from k",
    "topic_key": PAGES + "select page_id, ref, topic from t",
    "topic_group": PAGES + "select topic_key as topic, count(*) as n, string_agg(date_iso || '@' || url, ';' order by date_iso, page_id) as appearances, count(*) > 1 as several from t where topic_key is not null group by 1",
    "lead_appearance": PAGES + LEAD + " select topic, page_id, date_iso, decided from l",
    "best_version": """with r as (select conv_id, turn, min(turn) over (partition by conv_id) as first_turn,
  row_number() over (partition by conv_id order by role <> 'user' desc, length(text) > 200 desc, text <> '' desc, turn % 3 desc, turn) as n from conversations) select conv_id, turn, first_turn from r where n = 1""",
    "merged_versions": "select source as topic, doc_id as ref from (select source, doc_id, row_number() over (partition by source order by quality desc, doc_id) as n from labels join documents using (doc_id)) where n > 1",
    "title_clean": f"""with u as (select 'page ' || page_id as id, '2025-07-011 ' || {html_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} || ' (AZ: 2025-10-015)' as title from pages
union all select 'part ' || p_partkey, p_name || ' — ' || p_type || ' — ' || p_brand from part),
a as (select id, {plain_title('title')} as t from u), b as (select id, trim({squeeze(_cut)}, ' ;,:–—-') as c from a)
select id, case when length(c) > {text.MOST_TITLE} then regexp_replace(left(c, {text.MOST_TITLE}), ' [^ ]*$', '') || ' …' else c end as title from b""",
    "district_extract": "select p_partkey, case when p_size % 3 = 0 then 'IV-' || p_brand else '' end as district from part",
    "suffix_scrub": f"select doc_id, sha256({_scrub(chr(39) + 'Frau ' + chr(39) + ' || text')}) as scrubbed_sha256, length({_scrub(chr(39) + 'Bericht Herr Müller Referentin: ' + chr(39) + ' || text')}) as \"left\" from documents",
    "routine_flag": f"select doc_id, {some('text', rules.ROUTINE)} as routine, {some('text', (r'^the ', r' of the ', r'!!$'))} as plain from documents",
    "multi_label_tags": "with d as (select doc_id, text || ' ' || source || ' ' || lang as x from documents), t as (select doc_id, unnest([" + ", ".join(f"case when {found('x', bounded(p))} then {lit(label)} end" for p, label in rules.LIFE_SITUATIONS + rules.OCCASIONS) + "]) as tag from d) select distinct doc_id, tag from t where tag is not null",
    "heading_filter": PAGES + f"select page_id, length(title) < {rules.SHORT_HEADING} and not {found('title', rules.PLACE_WORD)} as collective, length(title) < {rules.SHORT_TITLE} as short from t",
    "heading_filter_titles": f"with t as (select 'part ' || p_partkey as id, p_name || ' ' || p_type as title from part union all select 'document ' || doc_id, regexp_extract(text, '^[^.!?]*') from documents) select id, length(title) < {rules.SHORT_HEADING} and not {found('title', rules.PLACE_WORD)} as collective, length(title) < {rules.SHORT_TITLE} as short, {found('title', rules.HOLDING_BODY)} as holding from t",
    "facet_filter": f"select p_partkey, p_brand, cast(p_size as bigint) as p_size from part where {IN_SELECTION}",
    "facet_counts": " union all ".join(f"select '{a}' as axis, cast({a} as varchar) as value, count(*) as n from part where {a} is not null group by 2" for a in ("p_brand", "p_type", "p_size")),
    "facet_page": f"select *, case when rank <= 8 then cast(1 as bigint) else 2 end as page from (select p_partkey, p_retailprice, row_number() over (order by p_retailprice desc, p_partkey) as rank from part where {IN_SELECTION}) where rank <= 28",
    "facet_summary": f"with h as (select count(*) as hits from part where {IN_SELECTION}) select hits, cast({sum(map(len, SELECTION.values()))} as bigint) as active, least(hits, 8) as shown, greatest(hits - 8, 0) as remaining, least(greatest(hits - 8, 0), 20) as next from h",
    "axis_values": "select distinct 'lang' as axis, lang as value from documents where lang is not null union all select distinct 'source', source from documents where source is not null union all select distinct 'event_type', event_type from events where event_type is not null",
    "axis_official_order": "with o(value, ord) as (values " + ", ".join(f"({lit(v)}, {i})" for i, v in enumerate(PRIORITIES)) + "), v as (select distinct o_orderpriority as value from orders) select v.value, row_number() over (order by ord nulls last, v.value) as position, ord is not null as official from v left join o on v.value = o.value",
    "status_derivation": STATUS + "select * from s",
    "status_distribution": STATUS + "select status, count(*) as n from s group by 1",
    "statuses_present": STATUS + "select * from (values ('Entscheidung geplant', cast(0 as bigint)), ('Wird noch beraten', 1), ('Entscheidung angesetzt', 2), ('Bekanntgabe', 3), ('Ohne Vorlage', 4)) v(status, ord) where status in (select status from s)",
    "inner_lookup": "select doc_id, lang, source, cast(quality as bigint) as quality from labels join documents using (doc_id)",
    "ref_index": "select l_orderkey as ref, cast(l_linenumber as bigint) as l_linenumber, l_partkey as item_ord from (select *, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc) as n from lineitem) where n = 1",
    "left_lookup_default": "select doc_id, source, coalesce('q' || quality, '') as label from documents left join labels using (doc_id)",
    "orphans": "select doc_id as ref from labels where doc_id not in (select doc_id from documents where lang <> 'en')",
    "uncurated": "select doc_id as ref from documents where lang <> 'es' and not n_chars < 300 and doc_id not in (select doc_id from labels)",
    "open_topics": "select o_custkey, count(*) as n_orders from orders where o_custkey not in (select o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')) group by 1",
    "semi_disjunctive": "select doc_id, doc_id in (select doc_id from labels) as by_ref, doc_id in (select item_id from benchmark) as by_topic from documents where doc_id in (select doc_id from labels) or doc_id in (select item_id from benchmark)",
    "first_match_per_group": "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from lineitem where l_returnflag = 'R') where n = 1",
    "work_queue_topk": "select o_orderkey, o_orderstatus = 'F' as decided, cast(strftime(o_orderdate, '%Y%m%d') as bigint) as number, coalesce(c_name, '') as c_name from orders left join customer on c_custkey = o_custkey order by decided desc, number desc, o_orderkey limit 25",
    "doc_priority": r"""with k as (select conv_id, turn, case when role = 'assistant' and conv_id % 2 = 0 then 'Antwort' when turn % 3 = 0 then 'Anfrage' when turn % 5 = 4 then 'Lageplan' else 'Text' end as kind from conversations),
m as (select *, max(kind = 'Antwort') over (partition by conv_id) as answered from k where kind <> 'Lageplan')
select conv_id, row_number() over (partition by conv_id order by case when not answered then 0 when kind = 'Antwort' then 0 when kind = 'Text' then 1 else 2 end, turn) - 1 as pos, kind || ' ' || turn as title from m""",
    "month_range": "with m as (select unnest(generate_series(date '1994-11-01', date '1996-02-01', interval 1 month)) as d) select year(d) as year, month(d) as month, count(o_orderkey) as n_orders from m left join orders on date_trunc('month', o_orderdate) = d group by all",
    "month_default": "with m(d, name) as (values (date '1995-11-01', 'November'), (date '1995-12-01', 'Dezember'), (date '1996-01-01', 'Januar')) select name || ' ' || year(d) as label, count(o_orderkey) as n_orders from m left join orders on date_trunc('month', o_orderdate) = d group by all",
    "per_source_stats": "with r as (select 'src' || unnest(range(25)) as source) select r.source, count(doc_id) as n, cast(coalesce(sum(n_chars), 0) as bigint) as chars, cast(coalesce(sum(case when n_chars < 300 then 1 else 0 end), 0) as bigint) as routine from r left join documents d on d.source = r.source group by 1",
    "union_sources": "select 'documents' as origin, doc_id as id, length(text) as length from documents union all select 'benchmark', item_id, length(text) from benchmark",
    "upsert_ignore": "select doc_id as ref, 'curated ' || quality as entry from labels union all select doc_id, 'draft ' || lang from documents where doc_id not in (select doc_id from labels)",
    "vocabulary_violations": f"select 'vocabulary' as \"check\", 'error' as severity, event_id as ref, 'life=' || event_type as detail from events where event_type not in ({', '.join(map(lit, ALLOWED_EVENTS))})",
    "duplicate_topics": PAGES + "select 'duplicate topic' as \"check\", 'error' as severity, topic as ref, cast(count(*) as varchar) as detail from t group by topic having count(*) > 1",
    "required_fields": r"""select 'required' as "check", 'error' as severity, 'd' || doc_id as ref, 'title_plain' as detail from documents where trim(regexp_replace(case when doc_id % 7 = 0 then '' else coalesce(text, '') end, '\s', ' ', 'g')) = ''
union all select 'required', 'warning', conv_id || '.' || turn, 'title_easy' from conversations where text <> '' and role <> 'user'""",
    "phrase_lint": f"select * from (select doc_id, regexp_extract(text, {lit(PHRASES)}, 0) as phrase, regexp_extract(text, {lit('(?i)' + rules.ASSERTED_OUTCOME)}, 0) as outcome from documents) where phrase <> '' or outcome <> ''",
    "sentence_lint": r"""with s as (select conv_id || '.' || turn as ref, regexp_replace(unnest(regexp_split_to_array(text, '[.!?]')), '^\s+|\s+$', '', 'g') as s from conversations),
w as (select ref, s, len(regexp_split_to_array(s, '\s+')) as n from s where s <> '') select 'sentence' as "check", 'warning' as severity, ref, n || ': ' || left(s, 52) as detail from w where n > 14""",
    "coverage_waterfall": f"""with r as (select case when doc_id in (select doc_id from labels where quality = 1 and toxic = 0) then {lit('im Feed')} when lang = 'es' then 'nicht oeffentlich' when n_chars < 300 then 'Sitzungsroutine'
  when source = 'src7' then 'Aufsichtsrat/Zweckverband' when length(text) < 12 then 'Titel zu kurz' when length(text) < 22 and not {found('text', rules.PLACE_WORD)} then 'Sammelueberschrift' else 'NOCH NICHT AUFBEREITET' end as reason from documents)
select reason, count(*) as n from r group by 1""",
    "loss_check": LOST.format(shown="source <> 'src7'"),
    "loss_check_public": LOST.format(shown="lang <> 'es'"),
    "prompt_bundle": r"""with b as (select doc_id, '## ' || doc_id || chr(10) || '- Gremium: ' || source || ' (01.07.2026)' || chr(10) || '- Amtlicher Titel: ' || text
  || case when doc_id % 2 = 0 then chr(10) || '- Zusatz: ' || lang else '' end || case when doc_id % 3 = 0 then chr(10) || '- Vorlage: ' || source else '' end || chr(10) || '- Entwurf-Titel: ' || lang || chr(10) as block from documents)
select doc_id, length(block) as length, sha256(block) as block_sha256 from b""",
    "date_reformat": "select o_orderkey, case when o_orderkey % 11 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end as iso, case when o_orderkey % 11 = 0 then '' else strftime(o_orderdate, '%d.%m.%Y') end as back, case when o_orderkey % 11 = 0 then 0 else cast(strftime(o_orderdate, '%Y%m%d') as bigint) end as number from orders",
    "batch_totals": "with b as (select case when lang = 'fr' then '' else text end as x from documents) select cast(sum(length(x)) as bigint) as characters, cast(sum(length(x)) // 4 as bigint) as tokens, count(*) filter (x = '') as without_text from b",
    "cache_keys": r"select page_id, regexp_extract(regexp_extract(url, '^(https?://[^/?#]+)', 1), '([^/]*)$', 1) || '_' || left(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), 140) || '.html' as page_key, right(regexp_replace(url, '[^A-Za-z0-9]', '_', 'g'), 120) || '.pdf' as pdf_key from pages",
    "card_values": STATUS + """select o_orderkey, case when o_orderkey % 2 = 0 then 'p' else 's' end as primary_url, case when status = 'Ohne Vorlage' then '' else status end as badge, case when status = 'Ohne Vorlage' then '' else lower(split_part(status, ' ', 1)) end as badge_class,
  case when o_orderkey % 5 = 0 then 'link' when starts_with(status, 'Entscheidung') then 'pending' else '' end as minutes_note, o_orderkey % 3 = 0 as draft_label from s""",
    "document_links": r"""with h as (select page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) as u, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) as t from pages),
e as (select page_id, unnest(u) as u, unnest(t) as t, unnest(range(len(u))) as i from h), k as (select page_id, u, min(i) as i, arg_min(t, i) as t from e where trim(t) <> '' group by 1, 2)
select page_id, row_number() over (partition by page_id order by i) - 1 as pos, trim(t) as title, case when starts_with(u, 'http') then u else 'http://h/' || ltrim(u, '/') end as url from k""",
    "candidates": f"select doc_id as ref from documents where lang <> 'es' and not n_chars < 300 and source <> 'src7' and length(text) >= {rules.SHORT_TITLE} and not (length(text) < {rules.SHORT_HEADING} and not {found('text', rules.PLACE_WORD)}) and doc_id not in (select doc_id from labels)",
    "chosen_sources": "select doc_id, source, 'src3' as choice from documents where source = 'src3' union all select doc_id, source, 'beide' from documents",
    "corpus_statistics": "select (select count(*) from customer) as sessions, count(*) as items, count(*) filter (o_orderstatus = 'F') as routine, cast(sum(o_orderkey % 3) as bigint) as stages, count(*) filter (o_orderpriority <> '5-LOW') as public_items from orders",
    "source_statistics": "with r as (select 'src' || unnest(range(9)) as source), s as (select 'src' || c_nationkey % 7 as source, count(*) as n from customer group by 1), i as (select 'src' || o_custkey % 5 as source, count(*) as n from orders group by 1) select r.source, coalesce(s.n, 0) as sessions, coalesce(i.n, 0) as items from r left join s using (source) left join i using (source)",
    "axis_cardinalities": " union all ".join(f"select '{a}' as axis, count(distinct {a}) as \"values\" from part" for a in ("p_brand", "p_type", "p_size")) + " union all select 'nothing', 0",
    "result_message": f"""with c as (select count(*) as total, count(*) filter ({IN_SELECTION}) as hits from part)
select total || ' Einträge — alle aufbereiteten Tagesordnungspunkte' as line, case when total = 0 then 'Keine Einträge für diese Kombination. Filter weiter fassen?' else '' end as empty, 'all' as choice from c
union all select hits || ' von ' || total || ' Einträgen passen zu Ihrer Auswahl', case when hits = 0 then 'Keine Einträge für diese Kombination. Filter weiter fassen?' else '' end, 'some' from c
union all select '0 von ' || total || ' Einträgen passen zu Ihrer Auswahl', 'Keine Einträge für diese Kombination. Filter weiter fassen?', 'none' from c""",
    "headline": "select (select count(*) from customer) as sessions, (select count(*) from orders) as items, count(*) as prepared, count(distinct p_brand) as districts from part",
    "provenance": "select 'Quellen: Stadt · Bezirke · Daten abgerufen am 03.07.2026 · Zeitraum 2026-05 bis 2026-07 · Aufbereitet: ' || (select count(*) from part) || ' von ' || count(*) || ' Tagesordnungspunkten (' || count(*) filter (o_orderstatus = 'F') || ' Sitzungsroutine ausgelassen).' as line from orders",
    "draft_report": "select count(*) as drafts, count(*) filter (p_size % 2 = 0 and p_size % 3 = 0) as without_tag, count(*) filter (p_size % 5 = 0) as without_district from part",
    "built_feed": BUILT + "select topic, ref, topic_ord, is_draft, date_iso, official_title, status, status_date, minutes_url, n_appearances from f",
    "archived_pages": PAGES + "select source, left(date_iso, 7) as month, body as host, regexp_replace(url, '^https?://[^/?#]+/?', '') as path, sha256(html) as html_sha256 from p where source in ('de', 'fr') and left(date_iso, 7) >= '2026-04'",
    "all_violations": rf"""with c as (select conv_id || '.' || turn as ref, role, text from conversations),
w as (select ref, regexp_replace(unnest(regexp_split_to_array(text, '[.!?]')), '^\s+|\s+$', '', 'g') as s from c),
n as (select ref, s, len(regexp_split_to_array(s, '\s+')) as n from w where s <> ''),
v as (select 'reference' as "check", 'error' as severity, ref, ref as detail from c
union all select 'reference', 'error', 'd' || doc_id, 'd' || doc_id from documents where lang = 'es'
union all select 'loss', 'error', ref, ref from c where text <> ''
union all select 'required', 'error', ref, 'title_plain' from c
union all select 'required', 'error', 'd' || doc_id, 'title_plain' from documents where trim(regexp_replace(coalesce(text, ''), '\s', ' ', 'g')) = ''
union all select 'required', 'warning', ref, 'title_easy' from c where text <> '' and role <> 'user'
union all select 'outcome', 'error', ref, 'text_plain: hat beschlossen' from c
union all select 'outcome', 'error', ref, 'text_easy: ' || regexp_extract(text, {lit('(?i)' + rules.ASSERTED_OUTCOME)}, 0) from c where {found('text', rules.ASSERTED_OUTCOME)}
union all select 'sentence', 'warning', ref, n || ': ' || left(s, 52) from n where n > 14
union all select 'vocabulary', 'error', 'd' || doc_id, 'life=' || lang from documents where lang not in ('de', 'en')
union all select 'vocabulary', 'error', 'd' || doc_id, 'district=' || lang from documents where lang <> 'fr'
union all select 'vocabulary', 'error', 'd' || doc_id, 'district=' || source from documents where source not in ({', '.join(lit(f'src{i}') for i in range(15))})
union all select 'duplicate topic', 'error', lang || '/' || source, cast(count(*) as varchar) from documents group by lang, source having count(*) > 1)
select * from v""",
    "facet_index": f"with s as (select * from part where {IN_SELECTION} and p_type in ('ECONOMY', 'STANDARD', 'PROMO')) select 'row' as part, '' as axis, '' as value, p_partkey as n from s union all select 'hits', '', cast((select count(*) from part) as varchar), count(*) from s"
    + "".join(f" union all select '{kind}', '{a}', cast({a} as varchar), count(*) from {t} where {a} is not null group by 3" for kind, t in (("all", "part"), ("selected", "s")) for a in ("p_brand", "p_type", "p_size"))
    + "".join(f" union all select 'values', '{a}', '', count(distinct {a}) from part" for a in ("p_brand", "p_type", "p_size")),
    "feed_round_trip": BUILT + f""", h(source) as (values ('de'), ('en'), ('es'), ('fr'), ('it')),
k as (select case when topic in (select topic from f) or ref in (select ref from f) then 'im Feed' when page_id % 10 = 0 then 'Sitzungsroutine' when {found('body', rules.HOLDING_BODY)} then 'Aufsichtsrat/Zweckverband' when length(title) < {rules.SHORT_TITLE} then 'Titel zu kurz' when length(title) < {rules.SHORT_HEADING} and not {found('title', rules.PLACE_WORD)} then 'Sammelueberschrift' else 'NOCH NICHT AUFBEREITET' end as reason from t)
select 'head' as part, 'drafts' as name, count(*) filter (is_draft) as n from f union all select 'head', 'easy', count(*) filter (best_id % 5 = 0) from f union all select 'head', 'curated', count(*) from f union all select 'rows', 'written', count(*) from f
union all select 'status', status, count(*) from f group by 2
union all select 'source', h.source, count(t.ref) from h left join t on t.source = h.source group by 2
union all select 'district', source, row_number() over (order by case source when 'fr' then 0 when 'de' then 1 else 2 end, source) - 1 from (select distinct source from f)
union all select 'coverage', reason, count(*) from k group by 2
union all select 'lost', ref, 1 from t where source <> 'es' and page_id % 5 = 0 and ref not in (select ref from f) and topic not in (select topic from f where best_id % 5 = 0)""",
    "feed_summary": BUILT + f""", r(source) as (values ('de'), ('en'), ('es'), ('fr'), ('it'))
select '{FEED_AS_OF}' as built, (select count(*) from pages) as sessions, (select count(*) from pages) as items, (select count(*) from pages where page_id % 10 = 0) as routine, count(*) as curated, count(*) filter (is_draft) as drafts, count(*) filter (best_id % 5 = 0) as easy,
  (select string_agg(source || '=' || n, ',' order by source) from (select r.source, (select count(*) from f join l using (topic) where l.source = r.source) as n from r)) as per_source,
  (select string_agg(status || '=' || n, ',' order by status) from (select status, count(*) as n from f group by 1)) as status,
  (select coalesce(max('x'), '') from f where best_id % 3 > 0) as life,
  (select string_agg(source, ',' order by case source when 'fr' then 0 when 'de' then 1 else 2 end, source) from (select distinct source from f)) as district,
  (select string_agg(o, ',' order by o) from (select distinct 'o' || best_id % 2 as o from f)) as occasion,
  (select string_agg(s, ',' order by o) from (values ('Entscheidung geplant', 0), ('Entscheidung angesetzt', 2), ('Ohne Vorlage', 4)) v(s, o) where s in (select status from f)) as statuses from f""",
}

ORACLE_SQL["violation_samples"] = f"""with v as ({ORACLE_SQL["required_fields"]} union all select * from ({ORACLE_SQL["sentence_lint"]})), r as (select *, row_number() over (partition by "check", severity order by ref, detail) as k from v)
select "check", severity, count(*) as n, string_agg(ref, ', ' order by k) filter (k <= 5) as refs from r group by 1, 2"""
