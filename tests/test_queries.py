"""Every query of the catalogue against its DuckDB SQL, and the entry module."""

import pytest

import __spark_entry__
from agoralake.plans.catalogue import QUERIES
from agoralake.plans.oracle import ORACLE_SQL

from .oracle import compare, connection

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


def test_feed_document_is_json(spark):
    [row] = QUERIES["feed_document"](spark, SF).collect()
    import json

    feed = json.loads(row["value"])
    dates = [e["date_iso"] for e in feed["entries"]]
    assert feed["statistics"]["curated"] == len(dates) and dates == sorted(dates, reverse=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _labels(searched):
    import re

    from agoralake.functions import rules

    return {label for p, label in rules.LIFE_SITUATIONS + rules.OCCASIONS if re.search(p, searched, re.I)}


def test_tags_are_those_of_all_rules(spark, tmp_path):
    words = ["Schulweg", "Ganztagsschule", "Vorschule", "Pflege", "Pflegeheim", "die Tafel", "Tafeln", "Miete", "Vermieter", "Bus 16", "Busse", "Omnibus", "am See", "Seen", "Überseebad", "öBad", "das Bad", "THI", "thing", "BHH", "VHS-Kurs", "Sitzbank", "Bank", "Bänke", "B 16", "Fest", "älteres Fest", "Park", "Straße", "GRÜN", "Ärzte", "", "nichts"]
    docs = [(i, w, f"src{i % 3}", "de") for i, w in enumerate(words)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in QUERIES["multi_label_tags"](spark, str(tmp_path)).collect()]
    want = {(i, label) for i, w, source, lang in docs for label in _labels(f"{w} {source} {lang}")}
    assert len(found) == len(set(found)) and set(found) == want
    from agoralake.functions import rules

    assert {label for _, label in want} >= {label for p, label in rules.LIFE_SITUATIONS + rules.OCCASIONS if r"\b" in p}


def test_keywords_are_found_as_by_their_patterns(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from agoralake.functions import keywords, rules

    table, pick = rules.LIFE_SITUATIONS + rules.OCCASIONS, random.Random(5)
    spelled = lambda p: re.sub(r"\(([^|)]*)\|([^)]*)\)", lambda m: pick.choice(m.groups()), p).replace(r"\b", "").replace(r"\.", ".").replace(".*", " x ").replace("?", "")
    words = [spelled(a) for p, _ in table for a in keywords.alternatives(p)] * 6
    cut = lambda w: w[: len(w) // 2] + w[len(w) // 2 + 1 :] if pick.random() < 0.2 else w
    texts = [(pick.choice(["", " ", "-", "ö", "x"]) + pick.choice([str.upper, str.title, str])(cut(w)).replace("s", pick.choice("ssſ")).replace("k", pick.choice("kk\u212a")) + pick.choice(["", " ", ".", "ä", "İ", "y"]),) for w in words]
    by_pattern = F.array_compact(F.array(*[F.when(F.col("x").rlike("(?iU)" + p), F.lit(label)) for p, label in table]))
    found = spark.createDataFrame(texts, "x string").select("x", by_pattern.alias("want"), rules.tags(F.col("x"), table).alias("got"))
    assert found.where("size(want) > 0").count() > len(texts) / 2
    assert found.where("want <> got").collect() == []


def test_routine_titles_are_found_as_by_their_patterns(spark):
    from pyspark.sql import functions as F

    from agoralake.functions import rules

    titles = [(a + t + b,) for t in ("Eröffnung", "BEGRUEßUNG", "Anfragen", "Anfragen aus dem Stadtteil", "Beschluss der Tagesordnung", "Wahlen der Sprecher", "Verkehr") for a in ("", "Die ") for b in ("", " heute")]
    by_pattern = F.col("x").rlike("(?iU)" + "|".join(f"(?:{p})" for p in rules.ROUTINE))
    rows = spark.createDataFrame(titles, "x string").select(by_pattern.alias("want"), rules.is_routine(F.col("x")).alias("got")).collect()
    assert {r["want"] for r in rows} == {True, False} and all(r["want"] == r["got"] for r in rows)


def test_headings_are_judged_by_whole_titles(spark, tmp_path):
    titles = ["Sanierung der alten Hauptstraße", "Zebrastreifen Uferallee", "Jugend", "Jugend und ganz andere Themen", "Neues vom Tage hier"]
    pages = [(i, f"http://h/de/{i}", f"<html><title>{t}</title></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["heading_filter"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [tuple(r) for r in found] == [(0, False, False), (1, False, False), (2, True, True), (3, False, False), (4, True, False)]


def test_headings_of_given_pages_fall_into_both_classes(spark):
    rows = QUERIES["heading_filter"](spark, SF).collect()
    assert {r["collective"] for r in rows} == {r["short"] for r in rows} == {True, False}


def test_feed_entries_are_those_of_the_document(spark):
    import json

    sf = "/root/testdata/sf0.001"
    whole = json.loads(QUERIES["feed_document"](spark, sf).first()["value"])
    rows = QUERIES["feed_entries"](spark, sf)
    assert [json.loads(r["value"]) for r in rows.collect()] == whole.pop("entries")
    assert json.loads(QUERIES["feed_header"](spark, sf).first()["value"]) == whole


def test_a_large_feed_is_no_single_document(spark):
    from agoralake.operators import feed

    entries = spark.createDataFrame([("a", "2026-01-01", 0, False, "", ["x"])], "ref string, date_iso string, topic_ord int, is_draft boolean, text_easy string, appearances array<string>")
    assert feed.feed_document(entries, {}).count() == 1
    with pytest.raises(ValueError, match="no single document"):
        feed.feed_document(entries, {}, most_bytes=10)


def test_best_versions_combine_before_the_shuffle(spark):
    assert "Window" not in QUERIES["best_version"](spark, SF)._jdf.queryExecution().toString()


ODD_ENTITIES = ["Straßen &amp;&amp;&amp", "R&D &am", "Wege &amp; Pl&auml;tze &#8212; a&#x41", "&quot;Nord&quot", "a&lt;b&gt &amp;nbsp;&nbsp;c", "K&copy &middot; &apos;x&#39;", "Halle&<b>amp;</b> Bad", "&lt;b&gt;x&lt;/b&gt;", ""]


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """Pages whose texts are cut off within an entity, or hold entities that SQL leaves; and DuckDB over them."""
    import duckdb

    sf = tmp_path_factory.mktemp("odd")
    pages = [(i, f"http://h/{('de', 'es')[i % 4 == 3]}/{i % 5}", f"<html><title>{t}</title><body><h1>{t}</h1><p>{t}</p></body></html>") for i, t in enumerate(ODD_ENTITIES)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{sf}/pages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").write.parquet(f"{sf}/part.parquet")
    con = duckdb.connect()
    for t in ("pages", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    return str(sf), con


@pytest.mark.parametrize("name", ["built_feed", "heading_filter", "html_text", "title_clean"])
def test_odd_entities_are_decoded_as_by_sql(spark, odd_pages, name):
    sf, con = odd_pages
    assert compare(QUERIES[name](spark, sf), con, ORACLE_SQL[name]) == ""


def test_title_clean_has_the_classes_and_nulls_of_sql(spark, tmp_path):
    """Letters after a citation, white space and digits beyond ASCII stay as SQL leaves them; nulls give null."""
    import duckdb

    odd = ["Bau gem\u00e4\u00df Art. 5 \u00d6ffentlich", "\u3000a \u2003b\u3000", "a\x0bb\x85c\u2028d", "x (AZ: \u0663)", "\u0662025-07-011 x", "gem. \u00a7 3 \u017ft \u212a", "no-break\u00a0space", "<br\x0b/>x", ""]
    pages = [(i, "http://h/de/1", f"<title>{t}</title>") for i, t in enumerate(odd)] + [(97, None, None), (98, "", "no title")]
    parts = [(i, t, t, "B") for i, t in enumerate(odd)] + [(96, None, "t", "b"), (97, "n", None, "b"), (98, "n", "t", None)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("pages", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert compare(QUERIES["title_clean"](spark, str(tmp_path)), con, ORACLE_SQL["title_clean"]) == ""


def test_feed_document_decodes_every_entity(spark, odd_pages):
    import html
    import json

    feed = json.loads(QUERIES["feed_document"](spark, odd_pages[0]).first()["value"])
    titles = {" ".join(html.unescape(t.replace("<b>", "").replace("</b>", "")).split()) for t in ODD_ENTITIES}
    shown = {e["title"] for e in feed["entries"]}
    assert shown <= titles and "Wege & Plätze — aA" in shown
