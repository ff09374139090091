"""The corpus pipeline: stage by stage against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from agoralake.llm import queries

from .conftest import CLASHING, SF
from .test_near import near
from .test_texts import overlaps, piece_ids


def test_stages(spark, documents):
    at, bench = documents, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        seen[name] = ([tuple(r) for r in at.select("doc_id", "text").collect()], [tuple(r) for r in out.select("doc_id", "text").collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == documents.columns
        at = spark.createDataFrame(out.collect(), out.schema)

    before, after = seen["language_id"]
    kept = {d for d, _ in after}
    assert all(d not in kept for d, t in before if not any(c.isalpha() for c in t or "")) and len(after) > 0.9 * len(before)

    before, after = seen["minhash_near_dedup"]
    _, component = near(before, 5, 80, 100)
    assert {d for d, _ in after} == {d for d, root in component.items() if d == root}

    before, after = seen["benchmark_decontamination"]
    assert {d for d, _ in after} == {d for d, t in before if not overlaps(t, bench, 10)[1]} and len(after) < len(before)

    before, after = seen["secret_scans"]
    assert {d for d, _ in after} == {d for d, _ in before} and sorted(after) != sorted(before)

    rows = at.select("text", "ids").collect()
    assert [list(r["ids"]) for r in rows] == piece_ids([r["text"] for r in rows])


def test_run_is_registered(spark):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert "ids" in out.columns and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_mixtures_of_languages_stay(spark, documents):
    parts = {}
    for lang in ("de", "en", "es", "fr"):
        texts = documents.where(f"lang = '{lang}' and length(text) > 300").orderBy("doc_id").limit(6).collect()
        parts[lang] = " ".join(r["text"] for r in texts)[:1500]
    rng = random.Random(7)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    mixed = [(-k, " ".join([*parts.values()][:k])) for k in range(1, 5)] + [(-5, "123 !? 456"), (-6, "")] + [(-10 - k, noise(n)) for k, n in enumerate((5, 20, 100, 1000))] + [(-21, "日本語のテキストです")]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(mixed, "doc_id bigint, text string"))
    docs = docs.join(documents.select("doc_id", "lang"), "doc_id", "left")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert {d for d in kept if d < 0} == {-1, -2, -3, -4}
    # of the corpus only texts without letters go
    assert {r["doc_id"] for r in documents.collect() if any(c.isalpha() for c in r["text"] or "")} == {d for d in kept if d >= 0}


def test_empty_repeated_and_clashing_rows(spark, documents):
    """All stages on an empty table, and on rows that repeat and have columns named like the operators' own."""
    some = documents.where("doc_id < 60").collect()
    docs = spark.createDataFrame([*some, *some[:20]], documents.schema).withColumns({name: F.lit(name) for name in CLASHING if name not in ("ids",)})
    for at in (docs.limit(0), docs):
        for name, stage in corpus_pipeline.STAGES:
            before, at = at, stage(spark, at, SF)
            assert at.columns[: len(docs.columns)] == docs.columns
            at = spark.createDataFrame(at.collect(), at.schema)
            assert at.count() <= before.count()
    texts = [r["text"] for r in at.collect()]
    assert 0 < len(texts) and all(r["c0"] == "c0" and r["node"] == "node" for r in at.collect())
