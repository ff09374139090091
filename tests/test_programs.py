"""From archived pages to a checked feed."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from agoralake import programs
from agoralake.sources import documents, records

from .test_archive import stored  # noqa: F401


def test_calendar_to_checked_feed(spark, stored, tmp_path):  # noqa: F811
    at = lambda name: str(tmp_path / name)
    registry = records.source_registry(spark, {"stadt": ("Stadt", "http://b"), "bza": ("Bezirke", "http://c")})
    told = programs.crawl(spark, stored[0], at("raw"), registry, "2026-07-15", first="2026-05", last="2026-07")
    counts = {r["source"]: (r["sessions"], r["items"]) for r in told.collect()}
    assert counts.keys() == {"stadt", "bza"} and all(n == (1, counts["stadt"][1]) and n[1] > 1 for n in counts.values())
    head = documents.read_raw_head(spark, at("raw")).first()
    assert head["quellen"]["stadt"]["anzahl_tops"] == counts["stadt"][1] and head["zeitraum"].asDict() == {"von": "2026-05", "bis": "2026-07"}
    Path(at("curation.json")).write_text(json.dumps({"_achsen": {"lebenslage": ["Jugend"], "bezirk": [], "anlass": []}, "eintraege": {"bza:7#Ö 1.7": {"klartext_titel": "Von Hand", "klartext": "Text", "klartext_leicht": "Leicht.", "klartext_titel_leicht": "Leicht"}}}))
    dry = programs.drafts(spark, at("raw"), at("curation.json"), None)
    assert [r["ref"] for r in dry.collect()] == ["stadt:7#Ö 1.7"] and programs.drafts(spark, at("raw"), at("curation.json"), None, source="bza").count() == 0
    programs.drafts(spark, at("raw"), at("curation.json"), at("curation2"), prompts=at("prompts"))
    [whole] = [json.loads(p.read_text()) for p in Path(at("curation2")).glob("part-*") if p.stat().st_size]
    assert list(whole["eintraege"]) == ["bza:7#Ö 1.7", "stadt:7#Ö 1.7"] and whole["_achsen"] == {"lebenslage": ["Jugend"], "bezirk": [], "anlass": []}
    assert whole["eintraege"]["bza:7#Ö 1.7"]["klartext_leicht"] == "Leicht." and whole["eintraege"]["stadt:7#Ö 1.7"]["entwurf"] is True and "klartext_leicht" not in whole["eintraege"]["stadt:7#Ö 1.7"]
    assert "## stadt:7#Ö 1.7" in "".join(p.read_text() for p in Path(at("prompts")).glob("part-*"))
    row = programs.feed(spark, at("raw"), at("curation2"), at("feed"), registry, "2026-07-15", "Stadt").first()
    assert (row["statistics"]["curated"], row["statistics"]["drafts"], row["statistics"]["per_source"]) == (2, 1, {"stadt": 1, "bza": 1})
    assert documents.read_feed_head(spark, at("feed")).first()["quellen"]["bza"]["name"] == "Bezirke"
    # the text of the one, a draft of the other: only drafts are open, from their own source
    assert [r["ref"] for r in programs.queue(spark, at("raw"), at("curation2")).collect()] == ["stadt:7#Ö 1.7"]
    assert programs.queue(spark, at("raw"), at("curation2"), source="bza").count() == 0
    batch = programs.queue(spark, at("raw"), at("curation2"), texts=spark.createDataFrame([("none", "t", 1, "")], "url string, text string, pages int, note string"))
    assert batch.count() == 1
    done = programs.check(spark, at("raw"), at("curation2"), at("feed"), at("found"))
    assert {r["check"] for r in done.violations.collect()} <= {"vocabulary"} and done.verdict == int(not done.violations.where(F.col("severity") == "error").isEmpty())
    assert {r["reason"]: r["n"] for r in done.coverage.collect()}["im Feed"] == 2
