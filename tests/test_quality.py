"""All checks in one scan, against the checks one by one."""

import random
import re

from pyspark.sql import functions as F

from agoralake.operators import quality

LABELS = "array<string>"


def test_one_scan_finds_what_the_checks_find(spark):
    rng = random.Random(3)
    easy = ["", None, "Kurz. Und klar.", "Der Rat hat beschlossen. " + "wort " * 20 + ".", "Ein Satz mit " + "vielen " * 15 + "Wörtern! Und noch " + "einer " * 16]
    rows = [(f"r{i % 180}", rng.choice(["Titel", "", " \t", None]), rng.choice(["", "Es wurde entschieden", None]), rng.choice(["", "t", None]), rng.choice(easy), rng.choices("abc", k=rng.randint(0, 3)), rng.choices("xy", k=rng.randint(0, 2)), rng.choices("pq", k=rng.randint(0, 2))) for i in range(200)]
    curation = spark.createDataFrame(rows, f"ref string, title_plain string, text_plain string, title_easy string, text_easy string, life {LABELS}, district {LABELS}, occasion {LABELS}").withColumn("cur_ord", F.monotonically_increasing_id())
    items = spark.createDataFrame([(f"r{i}",) for i in range(0, 180, 2)] * 2, "ref string")
    vocabulary = spark.createDataFrame([("life", "a"), ("life", "b"), ("district", "x")], "axis string, value string")
    for texts in ([""], ["", "e"], []):
        feed = spark.createDataFrame([(f"r{i}", f"t{i % 40}", t) for i in range(0, 180, 3) for t in texts], "ref string, topic string, text_easy string")
        parts = [quality.dangling(curation, items), quality.lost_easy_texts(curation, feed), quality.duplicate_topics(feed), quality.unknown_values(curation, vocabulary), quality.required_fields(curation), quality.asserted_outcomes(curation), quality.long_sentences(curation)]
        # the single checks tell a ref and value once, however many rows of the ref have it
        one_by_one = sorted(tuple(r) for p in parts for r in p.collect() if r["check"] != "vocabulary") + sorted(tuple(r) for r in parts[3].collect())
        together = quality.violations(curation, items, feed, vocabulary)
        rows_of = [tuple(r) for r in together.collect()]
        assert sorted(r for r in rows_of if r[0] != "vocabulary") + sorted({r for r in rows_of if r[0] == "vocabulary"}) == one_by_one and len(one_by_one) > 300
    assert quality.violations(curation, items, feed, vocabulary.limit(0)).where("check = 'vocabulary'").count() > 100


def test_the_curation_is_scanned_once(spark, tmp_path):
    schema = f"ref string, title_plain string, text_plain string, title_easy string, text_easy string, life {LABELS}, district {LABELS}, occasion {LABELS}"
    spark.createDataFrame([("a", "", "", "", "", ["z"], [], [])], schema).write.parquet(str(tmp_path / "curation"))
    curation = spark.read.parquet(str(tmp_path / "curation"))
    items, feed = spark.createDataFrame([("a",)], "ref string"), spark.createDataFrame([("a", "t", "")], "ref string, topic string, text_easy string")
    vocabulary = spark.createDataFrame([("life", "a")], "axis string, value string")
    found, seen = quality.observed(quality.violations(curation, items, feed, vocabulary))
    assert len(re.findall(r"Relation \[ref#\d+,title_plain", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    found.write.parquet(str(tmp_path / "found"))
    assert quality.observed_verdict(seen) == 1 == quality.verdict(spark.read.parquet(str(tmp_path / "found")))
    fine, seen = quality.observed(quality.violations(curation.withColumns({"title_plain": F.lit("t"), "life": F.array(F.lit("a")), "text_easy": F.lit("e")}), items, feed, vocabulary))
    assert {r["severity"] for r in fine.collect()} == {"warning"} and (quality.observed_verdict(seen), quality.observed_verdict(seen, strict=True)) == (0, 1)
