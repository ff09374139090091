"""Scenarios on small agendas: topics, status, feed, queue, quality, pages."""

import json
from http.client import HTTPException

import pytest
from pyspark.sql import functions as F

from agoralake.functions import rules, text
from agoralake.operators import facets, feed, quality, status, topics, worklist
from agoralake.sources import documents, fetch, pages, records, sinks
from agoralake.streaming import upserts

AS_OF = "2026-07-01"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def stage(date, role):
    return {"datum": date, "datum_anzeige": ".".join(reversed(date.split("-"))), "gremium": "Stadtrat", "top_nr": "1", "oeffentlich": True, "rolle": role, "sitzung_url": ""}


def item(nr="Ö 1", title="Neubau der Turnhalle an der Schulstraße", kvonr=None, stages=(), routine=False, public=True, docs=()):
    return {"nr": nr, "titel": title, "zusatz": "", "antragsteller": "", "nachtrag": "", "oeffentlich": public, "verfahren": routine, "vorlage": "V1" if kvonr else "", "vorlage_url": f"http://h/vo0050.php?__kvonr={kvonr}" if kvonr else "", "dokumente": list(docs), "beratungen": list(stages)}


def session(id_, date, tops, source="stadt", body="Stadtrat", docs=()):
    return {"id": id_, "kennung": f"K{id_}", "gremium": body, "raum": "", "datum": date, "datum_anzeige": ".".join(reversed(date.split("-"))) if date else "", "zeit": "", "url": f"http://h/{id_}", "dokumente": list(docs), "tops": tops, "quelle": source}


def entry(title="Titel", **more):
    return {"klartext_titel": title, "klartext": ""} | more


def load(spark, tmp_path, sessions, curation=None, axes=None):
    raw, cur = tmp_path / "raw.json", tmp_path / "cur.json"
    raw.write_text(json.dumps({"sitzungen": sessions}, ensure_ascii=False))
    cur.write_text(json.dumps({"_achsen": axes or {"lebenslage": [], "bezirk": [], "anlass": []}, "eintraege": curation or {}}, ensure_ascii=False))
    s = records.sessions_of(records.read_json(spark, str(raw), records.RAW_SCHEMA))
    c = records.read_json(spark, str(cur), records.CURATION_SCHEMA)
    return s, records.items_of(s), records.curation_of(c), records.vocabulary_of(c)


def test_scalars(spark):
    checks = [
        (text.html_text(F.lit("A<br/>B&amp;C")), "A — B&C"),
        (text.html_text(F.lit("&lt;b&gt;x&lt;/b&gt;")), "<b>x</b>"),
        (text.html_text(F.lit(" a  b ")), "a b"),
        (text.html_text(F.lit("&Auml;&#x41;&nbsp;&rarr;")), "ÄA →"),
        (text.iso_date(F.lit("03.07.2026")), "2026-07-03"),
        (text.iso_date(F.lit("99.99.2026")), "2026-99-99"),
        (text.iso_date(F.lit("morgen")), ""),
        (text.display_date(F.lit("2026-07-03")), "03.07.2026"),
        (text.display_date(F.lit("2026-07")), "2026-07"),
        (text.district_of(F.lit("Bezirksausschuss VII - Etting")), ["VII-Etting"]),
        (text.district_of(F.lit("Stadtrat")), []),
        (text.without_persons(F.lit("Bericht Herr Müller")), "Bericht"),
        (text.without_persons(F.lit("Konzept, Referent: Herr Müller\nmehr")), "Konzept,"),
        (text.absolute_url(F.lit("/x"), F.lit("B")), "B/x"),
        (text.absolute_url(F.lit("http://h/x"), F.lit("B")), "http://h/x"),
        (text.plain_title(F.lit("2025-07-011 Kraibergstraße Zebrastreifen")), "Kraibergstraße Zebrastreifen"),
        (text.plain_title(F.lit("Parksituation (AZ: 2025-10-015)")), "Parksituation"),
        (text.plain_title(F.lit("Kurz — " + "lang " * 5)), "Kurz — lang lang lang lang lang"),
        (text.plain_title(F.lit("Neubau der Grundschule am Park — Antrag")), "Neubau der Grundschule am Park"),
        (text.plain_title(F.lit("wort " * 40)), ("wort " * 22).strip() + " …"),
        (text.approximate_tokens(F.lit(7)), 1),
        (text.date_number(F.lit("")), 0),
        (text.month_name(F.lit(3)), "Maerz"),
        (rules.tags(F.lit("ÖPNV"), rules.LIFE_SITUATIONS), ["Unterwegs"]),
        (rules.tags(F.lit("Museen"), rules.LIFE_SITUATIONS), []),
        (rules.tags(F.lit("Viktualienmarkt"), rules.LIFE_SITUATIONS), []),
        (rules.tags(F.lit("öbad"), rules.LIFE_SITUATIONS), []),
        (rules.is_collective_heading(F.lit("Jugend")), True),
        (rules.is_collective_heading(F.lit("Trinkbrunnen Kanalstraße")), False),
        (rules.asserted_outcome(F.lit("Der Rat hat beschlossen")), "hat beschlossen"),
        (rules.asserted_outcome(F.lit("soll entscheiden")), ""),
        (rules.is_routine(F.lit("ERÖFFNUNG der Sitzung")), True),
        (rules.is_holding_body(F.lit("Aufsichtsrat der Klinikum GmbH")), True),
    ]
    got = spark.range(1).select(*[c.alias(f"x{i}") for i, (c, _) in enumerate(checks)]).first()
    assert [g for g in got] == [e for _, e in checks]


@pytest.mark.parametrize("roles,proposal,expected", [
    ([("2026-07-01", "Entscheidung")], "V", ("Entscheidung angesetzt", "01.07.2026")),
    ([("2026-07-02", "Entscheidung")], "V", ("Entscheidung geplant", "02.07.2026")),
    ([("2026-01-02", "Vorberatung und Entscheidung")], "V", ("Entscheidung angesetzt", "02.01.2026")),
    ([("2026-01-02", "Vorberatung"), ("2026-03-02", "Vorberatung")], "V", ("Wird noch beraten", "02.03.2026")),
    ([("2026-01-02", "Bekanntgabe")], "V", ("Bekanntgabe", "02.01.2026")),
    ([("2026-01-02", "Anhörung")], "V", ("Anhörung", "02.01.2026")),
    ([("2026-01-02", "Entscheidung")], "", ("Ohne Vorlage", "")),
    ([], "V", ("Ohne Vorlage", "")),
])
def test_status(spark, roles, proposal, expected):
    stages = F.array(*[F.struct(F.lit(d).alias("date_iso"), F.lit(".".join(reversed(d.split("-")))).alias("date_disp"), F.lit(r).alias("role")) for d, r in roles]).cast("array<struct<date_iso:string,date_disp:string,role:string>>")
    assert tuple(value(spark, status.derived(F.lit(proposal), stages, AS_OF))) == expected


def test_lead_feed_and_order(spark, tmp_path):
    decision = stage("2026-05-01", "Entscheidung")
    sessions = [
        session("1", "2026-05-01", [item(kvonr=7, stages=[decision])], docs=[{"titel": "Niederschrift", "url": "http://h/n1"}]),
        session("2", "2026-06-01", [item(kvonr=7, stages=[decision]), item("Ö 2", kvonr=8, stages=[decision])], docs=[{"titel": "NIEDERSCHRIFT alt", "url": "http://h/n2"}]),
        session("3", "2026-06-09", [item("Ö 1", kvonr=8, routine=True)]),
        session("4", "", [item("Ö 9", title="Ohne Datum im Rathaus")]),
    ]
    cur = {"stadt:1#Ö 1": entry("eins", entwurf=True), "stadt:2#Ö 1": entry("zwei", klartext="t", lebenslage=["Jugend"]), "stadt:4#Ö 9": entry("drei"), "stadt:3#Ö 1": entry("vier"), "stadt:99#Ö 1": entry("weg")}
    s, items, curation, vocabulary = load(spark, tmp_path, sessions, cur)
    built = feed.build_feed(s, items, curation, AS_OF)
    rows = {r["topic"]: r for r in built.collect()}
    assert rows["stadt:vorlage:7"]["session_url"] == "http://h/2" and rows["stadt:vorlage:7"]["ref"] == "stadt:2#Ö 1"
    assert rows["stadt:vorlage:7"]["minutes_url"] == "http://h/n2" and rows["stadt:vorlage:7"]["status"] == "Entscheidung angesetzt"
    assert rows["stadt:vorlage:8"]["session_url"] == "http://h/2"  # the routine appearance has no stages
    assert len(rows["stadt:vorlage:7"]["appearances"]) == 2 and len(rows["stadt:4#Ö 9"]["appearances"]) == 1
    assert [r["topic_ord"] for r in feed.ordered(built).collect()] == [0, 3, 2]
    assert [r["ref"] for r in topics.orphans(curation, items).collect()] == ["stadt:99#Ö 1"]
    assert [tuple(r) for r in topics.merged_versions(topics.curated_topics(curation, items)).collect()] == [("stadt:vorlage:7", "stadt:1#Ö 1")]
    registry = records.source_registry(spark, {"stadt": ("Stadt", "u"), "bza": ("BZA", "u")})
    assert {r["source"]: r["n"] for r in feed.per_source(built, registry).collect()} == {"stadt": 3, "bza": 0}
    assert feed.statistics(built).first()["several"] == 2
    found = quality.violations(curation, items, built, vocabulary)
    assert {r["check"] for r in found.collect()} == {"reference", "vocabulary"} and quality.verdict(found) == 1
    report = {r["reason"]: r["n"] for r in quality.coverage_report(items, built).collect()}
    assert report == {"im Feed": 5}
    assert len(json.loads(sinks.json_document(feed.feed_document(built, {"stadt": "X"})).first()["value"])["entries"]) == 3
    assert sinks.script_document(feed.statistics(built)).first()["value"].startswith("window.FEED = {")


def test_ties_and_shared_refs(spark, tmp_path):
    sessions = [session("1", "2026-05-01", [item("Ö", kvonr=1), item("Ö", title="Zweiter Punkt ohne eigene Nummer", kvonr=2)]), session("2", "2026-05-01", [item("Ö 3", kvonr=1)])]
    s, items, curation, _ = load(spark, tmp_path, sessions, {"stadt:1#Ö": entry()})
    assert topics.ref_index(items).where("ref = 'stadt:1#Ö'").first()["proposal_url"].endswith("2")
    lead = {r["topic"]: r["session_id"] for r in topics.lead_appearances(items).collect()}
    assert lead == {"stadt:vorlage:1": "1", "stadt:vorlage:2": "1"}
    same = {"stadt:1#Ö": entry("a", klartext="x"), "stadt:2#Ö 3": entry("b", klartext="x")}
    _, items, curation, _ = load(spark, tmp_path, [session("1", "2026-05-01", [item("Ö", kvonr=1)]), session("2", "2026-05-02", [item("Ö 3", kvonr=1)])], same)
    assert topics.best_versions(topics.curated_topics(curation, items)).first()["title_plain"] == "a"


def test_curation_keeps_file_order(spark, tmp_path):
    import random

    keys = [f"stadt:{i}#Ö 1" for i in range(300)]
    random.Random(5).shuffle(keys)
    _, _, curation, _ = load(spark, tmp_path, [], {k: entry() for k in keys})
    assert [r["ref"] for r in curation.orderBy("cur_ord").collect()] == keys


def test_missing_file(spark, tmp_path):
    with pytest.raises(records.MissingInput):
        records.read_json(spark, str(tmp_path / "none.json"), records.RAW_SCHEMA)


def test_quality_checks(spark):
    cur = spark.createDataFrame([("a", "", "Der Rat hat beschlossen.", "", "leicht. " + "wort " * 15, 0), ("b", "t", "", "", "wort " * 14, 1)], "ref string, title_plain string, text_plain string, title_easy string, text_easy string, cur_ord int")
    assert {(r["severity"], r["detail"]) for r in quality.required_fields(cur).collect()} == {("error", "title_plain"), ("warning", "title_easy")}
    assert [r["detail"] for r in quality.asserted_outcomes(cur).collect()] == ["text_plain: hat beschlossen"]
    assert [r["ref"] for r in quality.long_sentences(cur).collect()] == ["a"]
    shown = spark.createDataFrame([("x", "t1", "leicht")], "ref string, topic string, text_easy string")
    curated = spark.createDataFrame([("a", "t2"), ("b", "t1")], "ref string, topic string")
    assert quality.lost_easy_texts(cur, shown).count() == 0
    assert [r["ref"] for r in quality.lost_easy_texts(cur, shown, curated).collect()] == ["a"]
    assert quality.duplicate_topics(shown.union(shown)).first()["ref"] == "t1"
    warnings = quality.long_sentences(cur)
    assert quality.verdict(warnings) == 0 and quality.verdict(warnings, strict=True) == 1


def test_coverage_order(spark):
    items = spark.createDataFrame([("r1", "t1", False, True, "Stadtrat", "Titel lang genug fuer alles", 1, 0), ("r2", "t2", True, False, "Beirat", "Titel lang genug fuer alles", 2, 0), ("r3", "t3", True, False, "Rat", "kurz", 3, 0), ("r4", "t4", True, False, "Rat", "Inklusion und mehr", 4, 0), ("r5", "t5", True, False, "Rat", "Titel lang genug fuer alles", 5, 0)], "ref string, topic string, is_public boolean, is_routine boolean, body string, title string, session_ord int, item_ord int")
    shown = spark.createDataFrame([], "ref string, topic string")
    assert [r["reason"] for r in quality.coverage_report(items, shown).collect()] == ["nicht oeffentlich", "Aufsichtsrat/Zweckverband", "Titel zu kurz", "Sammelueberschrift", "NOCH NICHT AUFBEREITET"]


def test_queue_drafts_and_upsert(spark, tmp_path):
    docs = [{"titel": "Anfrage der Fraktion", "url": "q"}, {"titel": "Lageplan", "url": "p"}, {"titel": "Vorlage", "url": "v"}, {"titel": "Antwort der Verwaltung", "url": "a"}]
    sessions = [
        session("1", "2026-01-01", [item(kvonr=1, stages=[stage("2026-01-01", "Entscheidung")], docs=docs)]),
        session("2", "2026-06-01", [item("Ö 2", kvonr=2, stages=[stage("2026-06-01", "Vorberatung")]), item("Ö", kvonr=3), item("Ö 4", title="Kurz"), item("Ö 5", kvonr=5)]),
        session("3", "2026-06-01", [item("Ö 1", title="Jahresabschluss der Klinikum gGmbH")], body="Aufsichtsrat"),
    ]
    _, items, curation, _ = load(spark, tmp_path, sessions, {"stadt:2#Ö 5": entry("x", klartext="fertig"), "stadt:2#Ö 2": entry("Entwurf", entwurf=True)})
    queue = worklist.work_queue(items, curation).collect()
    assert [r["topic"] for r in queue] == ["stadt:vorlage:1", "stadt:vorlage:2"]
    assert queue[0]["document"] == "Antwort der Verwaltung" and queue[0]["skipped"] == 1 and queue[1]["note"] == "kein Hauptdokument"
    assert worklist.work_queue(items, curation, 0).count() == 0
    found = worklist.candidates(items, curation)
    made = worklist.drafts(found)
    assert {r["ref"] for r in made.collect()} == {"stadt:1#Ö 1", "stadt:2#Ö"} and worklist.drafts(found, 1).count() == 1
    assert made.where("ref = 'stadt:1#Ö 1'").first()["life"] == ["Eltern & Kinder", "Unterwegs"]
    assert worklist.candidates(items, curation, holding=True).count() == found.count() + 1
    merged = worklist.upsert_ignore(curation, made.withColumn("title_plain", F.lit("neu")))
    got = {r["ref"]: r["title_plain"] for r in merged.collect()}
    assert got["stadt:2#Ö 2"] == "Entwurf" and got["stadt:1#Ö 1"] == "neu" and len(got) == 4
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.7")), ("b", bytearray(b"GIF")), ("c", None), ("d", bytearray(b"%PDF scan"))], "url string, content binary")
    texts = fetch.pdf_text(files, lambda content, most: ([] if b"scan" in content else ["Seite", "", "", "", "zwei"], 20))
    assert {r["url"]: (r["text"], r["pages"], r["note"]) for r in texts.collect()} == {"a": ("Seite\n\nzwei", 20, ""), "b": ("", 0, "kein PDF"), "c": ("", 0, "nicht ladbar"), "d": ("", 20, "gescannt, keine Textebene — braeuchte OCR")}
    totals = worklist.batch_totals(worklist.with_texts(worklist.work_queue(items, curation), texts)).first()
    assert (totals["characters"], totals["tokens"], totals["without_text"]) == (11, 2, 1)


def test_document_order_without_answer(spark):
    docs = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(t).alias("url")) for t in ("Anfrage", "Vorlage")])
    assert [d["title"] for d in value(spark, rules.prioritised(docs))] == ["Anfrage", "Vorlage"]


def test_facets(spark):
    rows = spark.createDataFrame([(1, ["a", "x"], "c"), (2, ["b"], "c"), (3, ["a"], "d"), (4, [], "c")], "id int, one array<string>, two string")
    assert [r["id"] for r in facets.select(rows, {"one": ["a", "b"], "two": ["c"], "three": []}).orderBy("id").collect()] == [1, 2]
    assert {(r["axis"], r["value"]): r["n"] for r in facets.counts(rows, ["one", "two"]).collect()} == {("one", "a"): 2, ("one", "x"): 1, ("one", "b"): 1, ("two", "c"): 3, ("two", "d"): 1}
    assert facets.paging(30, 8) == (22, 20) and facets.paging(30, 28) == (2, 2)
    assert facets.summary(rows, {}).first()["hits"] == 4


def test_months(spark):
    assert records.months(spark, "2026-02", "2025-11", AS_OF).count() == 0
    assert [tuple(r) for r in records.months(spark, "2025-11", "2026-02", AS_OF).collect()] == [(2025, 11), (2025, 12), (2026, 1), (2026, 2)]
    assert [tuple(r) for r in records.months(spark, None, None, AS_OF).collect()] == [(2026, 5), (2026, 6), (2026, 7)]


SESSION = """<div class="smc-table-cell siname">STR/1</div><div class="smc-table-cell sigrname">Stadtrat &amp; mehr</div><div class="smc-table-cell sidat">01.07.2026</div>
<div class="smc-dg-c-1-10 smc-documents"><div class="smc-el-h x"> <a href="getfile.php?id=1&amp;type=do">Bekanntmachung</a></div><div class="smc-el-h"><a href="getfile.php?id=2"> </a></div><div class="smc-el-h"><a href="getfile.php?id=1&amp;type=do">doppelt</a></div></div>
<div id="smcaccordion"><div class="card card-light"><span class="badge">Ö 1.7 Nachtrag: 28.07.2026</span><div class="smc-card-text-title">Neubau Halle<br/>- Antrag der Fraktion X<br />(Referent: Herr Y)</div><a href="vo0050.php?__kvonr=42" class="b"> <i></i> V/42 </a></div>
<div class="card card-light"><div class="smc-card-text-title">ohne Nummer</div></div>
<div class="card card-light x"><span class="badge">N 2</span><div class="smc-card-text-title">Genehmigung der Niederschrift</div></div></div>"""
STAGES = """<div id="smcpanel2"><button aria-controls="smcacchead2" > 02.07.2026 Stadtrat TOP 3 öffentlich - Entscheidung</button><a href="si0056.php?__ksinr=9">x</a>
<div id="smcpanel1"><button aria-controls="smcacchead1">01.06.2026  Ausschuss f. Sport TOP 1.2 nicht &ouml;ffentlich - Anhörung <</button>
<div id="smcpanel3"><button aria-controls="smcacchead3">kaputt</button>"""


def test_pages(spark):
    rows = spark.createDataFrame([("stadt", "7", "http://b", SESSION, 0), ("stadt", "8", "http://b", "", 1), ("stadt", "9", "http://b", "<div>leer</div>", 2)], "source string, session_id string, base_url string, html string, session_ord int")
    found = {r["session_id"]: r for r in pages.parse_sessions(rows).collect()}
    assert set(found) == {"7", "9"} and found["7"]["body"] == "Stadtrat & mehr" and found["7"]["date_iso"] == "2026-07-01"
    assert [tuple(d) for d in found["7"]["session_documents"]] == [("Bekanntmachung", "http://b/getfile.php?id=1&type=do")]
    items = pages.parse_items(rows)
    one, two = items.orderBy("item_ord").collect()
    assert (one["nr"], one["addendum"], one["title"], one["applicant"], one["suffix"]) == ("Ö 1.7", "28.07.2026", "Neubau Halle", "Antrag der Fraktion X", "Referent: Herr Y")
    assert one["proposal"] == "V/42" and one["topic"] == "stadt:vorlage:42" and one["is_public"] and not one["is_routine"]
    assert two["nr"] == "N 2" and not two["is_public"] and two["is_routine"] and two["proposal_url"] == ""
    assert [tuple(r) for r in pages.stage_requests(items).collect()] == [("stadt", "42")]
    fetched = spark.createDataFrame([("stadt", "42", "http://b", STAGES)], "source string, proposal_no string, base_url string, html string")
    with_stages = pages.attach_stages(items, fetched).orderBy("item_ord").collect()
    assert [(s["date_iso"], s["nr"], s["is_public"], s["role"], s["session_url"]) for s in with_stages[0]["stages"]] == [("2026-06-01", "1.2", False, "Anhörung", ""), ("2026-07-02", "3", True, "Entscheidung", "http://b/si0056.php?__ksinr=9")]
    assert with_stages[1]["stages"] == []
    calendar = spark.createDataFrame([(0, "si0056.php?__ksinr=5 si0056.php?__ksinr=4 si0056.php?__ksinr=5"), (1, "si0056.php?__ksinr=4 si0056.php?__ksinr=6")], "page_ord int, html string")
    assert [r["session_id"] for r in pages.session_ids(calendar).orderBy("ord").collect()] == ["5", "4", "6"]


def test_every_entity_is_decoded(spark):
    import html

    parts = ["Er&ouml;ffnung &amp; Begr&#252;&szlig;ung", "&amp;auml;", "&rsquo;&#8217;&#x41;&copy;", "&<b>auml;</b>", "R&D &ampx", "&lt;b&gt;&nbsp;", "", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, x string")
    want = [" ".join(html.unescape((p or "").replace("<b>", "").replace("</b>", "")).split()) for p in parts]
    assert [r["t"] for r in rows.select("i", text.html_text(F.col("x")).alias("t")).orderBy("i").collect()] == want
    page = SESSION.replace("Genehmigung der Niederschrift", "Er&ouml;ffnung der Sitzung").replace("Bekanntmachung", "Pl&auml;ne").replace("&amp;type", "&#38;type")
    one = spark.createDataFrame([("stadt", "7", "http://b", page, 0)], "source string, session_id string, base_url string, html string, session_ord int")
    assert [tuple(d) for d in pages.parse_sessions(one).first()["session_documents"]] == [("Pläne", "http://b/getfile.php?id=1&type=do")]
    assert [(r["title"], r["is_routine"]) for r in pages.parse_items(one).orderBy("item_ord").collect()][1] == ("Eröffnung der Sitzung", True)
    stages = value(spark, pages.parse_stages(F.lit(STAGES.replace("Anhörung", "Anh&#246;rung").replace("f. Sport", "f&uuml;r Sport")), F.lit("http://b")))
    assert (stages[0]["role"], stages[0]["body"]) == ("Anhörung", "Ausschuss für Sport")


def _archive(url):
    if url.endswith("bad"):
        raise OSError("no")
    return b"<p>\xff" + url.encode() + b"</p>"


def test_fetch_uses_and_fills_the_cache(spark):
    wanted = spark.createDataFrame([("http://h/a", "x.php?1"), ("http://h/b", "x.php?1"), ("http://h/a", "bad")], "base_url string, path string")
    cache = spark.createDataFrame([("a_x.php_1.html", "cached")], "key string, html string")
    got, new = fetch.fetch_pages(wanted, cache, _archive, pause=0)
    assert {(r["base_url"], r["path"]): r["html"] for r in got.collect()} == {("http://h/a", "x.php?1"): "cached", ("http://h/b", "x.php?1"): "<p>�http://h/b/x.php?1</p>", ("http://h/a", "bad"): ""}
    assert [r["key"] for r in new.collect()] == ["b_x.php_1.html"]
    got, new = fetch.fetch_pages(wanted, cache, _archive, pause=0, use_cache=False)
    assert {r["key"] for r in new.collect()} == {"a_x.php_1.html", "b_x.php_1.html"} and got.where("html = 'cached'").isEmpty()


def test_stream_inserts_only(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "ref string, title string"
    spark.createDataFrame([("a", "alt"), ("b", "b")], schema).write.json(str(source))
    upserts.insert_only(spark.readStream.schema(schema).json(str(source)), str(out), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", "neu"), ("c", "c")], schema).write.mode("append").json(str(source))
    upserts.insert_only(spark.readStream.schema(schema).json(str(source)), str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(out)).collect()) == [("a", "alt"), ("b", "b"), ("c", "c")]


def test_misses_are_fetched_once(spark, tmp_path):
    log = tmp_path / "log"

    def logged(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        if "worse" in url:
            raise HTTPException("cut short")
        return b"<p>x</p>"

    wanted = spark.createDataFrame([("http://h/a", "one"), ("http://h/a", "two"), ("http://h/a", "worse")], "base_url string, path string")
    cache = spark.createDataFrame([], "key string, html string")
    got, new = fetch.fetch_pages(wanted, cache, logged, pause=0)
    assert got.count() == 3 and new.count() == 2 and got.where("html = ''").count() == 1 and got.count() == 3
    assert len(log.read_text().split()) == 3


def test_files_come_from_the_cache_or_the_network(spark, tmp_path):
    def answer(url):
        if url.endswith("gone"):
            raise OSError("no route")
        return b"%PDF " + url.encode()

    wanted = spark.createDataFrame([("http://h/1",), ("http://h/2",), ("http://h/gone",), ("http://h/1",)], "url string")
    cache = spark.createDataFrame([("http___h_2.pdf", bytearray(b"%PDF cached"))], "key string, content binary")
    files, new = fetch.fetch_files(wanted, cache, answer, pause=0)
    assert {r["url"]: r["content"] and bytes(r["content"]) for r in files.collect()} == {"http://h/1": b"%PDF http://h/1", "http://h/2": b"%PDF cached", "http://h/gone": None}
    assert [r["key"] for r in new.collect()] == ["http___h_1.pdf"]
    texts = fetch.pdf_text(files, lambda content, most: ([content.decode()], 1))
    assert {r["url"]: r["note"] for r in texts.collect()} == {"http://h/1": "", "http://h/2": "", "http://h/gone": "nicht ladbar: no route"}
    fetch.append_cache(new, str(tmp_path / "cache"))
    assert fetch.read_cache(spark, str(tmp_path / "cache")).count() == 1


def test_a_crawl_of_archived_pages(spark):
    calendar = spark.createDataFrame([("stadt", "http://b", 0, "si0056.php?__ksinr=9 si0056.php?__ksinr=7"), ("stadt", "http://b", 1, "si0056.php?__ksinr=7")], "source string, base_url string, page_ord int, html string")
    fetched = spark.createDataFrame([("stadt", "7", SESSION), ("stadt", "9", ""), ("stadt", "1", SESSION)], "source string, session_id string, html string")
    stages = spark.createDataFrame([("stadt", "42", "http://b", STAGES)], "source string, proposal_no string, base_url string, html string")
    sessions, items = pages.crawl(calendar, fetched, stages)
    assert [(r["session_id"], r["session_ord"]) for r in sessions.collect()] == [("7", 1)]
    assert [(r["nr"], len(r["stages"])) for r in items.orderBy("item_ord").collect()] == [("Ö 1.7", 2), ("N 2", 0)]


def test_raw_corpus_is_read_back(spark, tmp_path):
    sessions = [session("1", "2026-06-01", [item("Ö 1", kvonr=1, stages=[stage("2026-06-02", "Entscheidung")], docs=[{"titel": "D", "url": "u"}]), item("Ö 2", routine=True)]), session("2", "", [])]
    found, items, _, _ = load(spark, tmp_path, sessions)
    own = items.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("item_ord", "nr", "title", "suffix", "applicant", "addendum", "is_public", "is_routine", "proposal", "proposal_url", "documents", "stages"))).alias("items"))
    whole = found.drop("items").join(own, "session_id", "left").withColumn("items", F.coalesce("items", F.array().cast(own.schema["items"].dataType)))
    raw = records.raw_sessions(whole)
    back = [json.loads(r["value"]) for r in sinks.json_lines(raw.orderBy("id")).collect()]
    assert back == sessions
    registry = records.source_registry(spark, {"stadt": ("Stadt", "http://s"), "bza": ("BZA", "http://b")})
    head = documents.raw_head(whole, registry, "Ohne Anmeldung.", "2026-07-03", "2026-05", "2026-07")
    made = json.loads(documents.document(head, documents.own_sessions(whole), "sitzungen").first()["value"])
    one = lambda name, url, n, m: {"name": name, "software": "", "basis_url": url, "anzahl_sitzungen": n, "anzahl_tops": m}
    assert list(made) == ["quellen", "hinweis", "abgerufen_am", "zeitraum", "anzahl_sitzungen", "anzahl_tops", "anzahl_verfahren", "sitzungen"]
    assert made == {"quellen": {"stadt": one("Stadt", "http://s", 2, 2), "bza": one("BZA", "http://b", 0, 0)}, "hinweis": "Ohne Anmeldung.", "abgerufen_am": "2026-07-03", "zeitraum": {"von": "2026-05", "bis": "2026-07"}, "anzahl_sitzungen": 2, "anzahl_tops": 2, "anzahl_verfahren": 1, "sitzungen": sessions}
    (tmp_path / "again.json").write_text(json.dumps(made, ensure_ascii=False))
    documents.write_head(head, str(tmp_path / "folder"))
    assert documents.write_rows(documents.own_sessions(whole), str(tmp_path / "folder"))["rows"] == 2
    for form in ("again.json", "folder"):
        again = documents.read_sessions(spark, str(tmp_path / form))
        assert again.columns == found.columns and sorted(map(str, again.collect())) == sorted(map(str, found.collect()))


def test_a_large_corpus_is_read_by_many_tasks(spark, tmp_path):
    sessions = [session(str(i), "2026-06-01", [item("Ö 1", kvonr=i)]) for i in range(3000)]
    found, _, _, _ = load(spark, tmp_path, sessions)
    items = F.transform("items", lambda t: F.struct(*[t[a].alias(b) for a, b in (("nr", "nr"), ("titel", "title"), ("zusatz", "suffix"), ("antragsteller", "applicant"), ("nachtrag", "addendum"), ("oeffentlich", "is_public"), ("verfahren", "is_routine"), ("vorlage", "proposal"), ("vorlage_url", "proposal_url"))], records._documents(t["dokumente"]).alias("documents"), records._stages(t["beratungen"]).alias("stages")))
    documents.write_rows(documents.own_sessions(found.withColumn("items", items)), str(tmp_path / "folder"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        again = documents.read_sessions(spark, str(tmp_path / "folder"))
        tasks = again.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 3 and again.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_feed_is_written_and_read_in_both_forms(spark, tmp_path):
    decision = stage("2026-05-01", "Entscheidung")
    sessions = [session("1", "2026-05-01", [item(kvonr=7, stages=[decision], docs=[{"titel": "D", "url": "u"}])], docs=[{"titel": "Niederschrift", "url": "http://h/n1"}]), session("2", "2026-06-01", [item("Ö 2", routine=True), item("Ö 3", title="Ein Radweg in der Stadt")], source="bza"), session("4", "", [item("Ö 9", title="Ohne Datum im Rathaus")])]
    cur = {"stadt:4#Ö 9": entry("drei", entwurf=True, bezirk=["B"]), "stadt:1#Ö 1": entry("eins", klartext_leicht="Leicht.", lebenslage=["Jugend"], bezirk=["C", "A"]), "bza:2#Ö 3": entry("zwei", anlass=["Klima"])}
    s, items, curation, _ = load(spark, tmp_path, sessions, cur)
    built = feed.build_feed(s, items, curation, AS_OF)
    registry = records.source_registry(spark, {"stadt": ("Stadt", "http://s"), "bza": ("BZA", "http://b"), "x": ("X", "http://x")})
    official = spark.createDataFrame([("C", 0), ("Z", 1)], "value string, ord int")
    raw = documents.raw_head(s.withColumn("items", F.transform("items", lambda t: F.struct(t["verfahren"].alias("is_routine")))), registry, "Hinweis", "2026-07-03", "2026-05", "2026-07")
    head = documents.own_head(feed.full_header(built, s, items, registry, official, {}), raw, "Stadt", AS_OF)
    made = json.loads(documents.document(head, documents.own_entries(built), "eintraege").first()["value"])
    assert list(made) == ["stadt", "quellen", "hinweis", "daten_abgerufen_am", "feed_gebaut_am", "zeitraum", "statistik", "achsen", "eintraege"]
    assert made["statistik"] == {"sitzungen_ausgelesen": 3, "tops_ausgelesen": 4, "tops_verfahren": 1, "tops_kuratiert": 3, "entwuerfe": 1, "leichte_sprache": 1, "je_quelle": {"bza": 1, "stadt": 2, "x": 0}, "stand": {"Entscheidung angesetzt": 1, "Ohne Vorlage": 2}}
    assert made["achsen"] == {"lebenslage": ["Jugend"], "bezirk": ["C", "A", "B"], "anlass": ["Klima"], "stand": ["Entscheidung angesetzt", "Ohne Vorlage"]}
    assert [e["ref"] for e in made["eintraege"]] == ["bza:2#Ö 3", "stadt:1#Ö 1", "stadt:4#Ö 9"] and all(len(e) == 28 for e in made["eintraege"])
    first = made["eintraege"][1]
    assert (first["thema"], first["niederschrift_url"], first["dokumente"], first["auftritte"][0]["sitzung_url"], first["beratungsweg"][0]["rolle"]) == ("stadt:vorlage:7", "http://h/n1", [{"titel": "D", "url": "u"}], "http://h/1", "Entscheidung")
    (tmp_path / "feed.json").write_text(json.dumps(made, ensure_ascii=False))
    documents.write_head(head, str(tmp_path / "feed"))
    documents.write_rows(documents.own_entries(built), str(tmp_path / "feed"))
    columns = [ours for _, ours in documents.ENTRY]
    for form in ("feed.json", "feed"):
        back = documents.read_feed(spark, str(tmp_path / form))
        assert [r["ref"] for r in back.orderBy("feed_ord").collect()] == [e["ref"] for e in made["eintraege"]]
        assert sorted(map(repr, map(tuple, back.select(columns).collect()))) == sorted(map(repr, map(tuple, built.select(columns).collect())))
        stored = documents.read_feed_head(spark, str(tmp_path / form)).first()
        assert stored["statistik"]["je_quelle"] == made["statistik"]["je_quelle"] and stored["quellen"]["bza"]["anzahl_tops"] == 2
        assert quality.duplicate_topics(back).isEmpty() and quality.lost_easy_texts(curation, back).isEmpty()
        assert {r["reason"]: r["n"] for r in quality.coverage_report(items, back).collect()} == {"im Feed": 3, "Sitzungsroutine": 1}
    with pytest.raises(ValueError, match="no single document"):
        documents.document(head, documents.own_entries(built), "eintraege", most_bytes=10)
    with pytest.raises(records.MissingInput):
        documents.read_feed(spark, str(tmp_path / "none.json")).count()


def test_a_feed_with_missing_fields(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text(json.dumps({"feed_gebaut_am": "x", "eintraege": [{"ref": "b", "entwurf": True}, {"ref": "a", "stand": "Bekanntgabe", "thema": "t"}]}))
    rows = documents.read_feed(spark, str(path)).orderBy("feed_ord").collect()
    assert [(r["ref"], r["topic"], r["is_draft"], r["status"], r["documents"]) for r in rows] == [("b", "", True, "", []), ("a", "t", False, "Bekanntgabe", [])]
