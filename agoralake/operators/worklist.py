"""Draft entries, the work queue of topics without a text, and the upsert into the curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import approximate_tokens, date_number, district_of, known, plain_title, without_persons
from .topics import curated_topics, has_decision


def candidates(items: DataFrame, curation: DataFrame, source: str | None = None, holding: bool = False) -> DataFrame:
    """Uncurated public items with a title that says something."""
    out = items if source is None else items.where(F.coalesce("source", F.lit("stadt")) == source)
    if not holding:
        out = out.where(~rules.is_holding_body(F.col("body")))
    out = out.where(F.col("is_public") & ~F.col("is_routine") & ~rules.is_short(F.col("title")) & ~rules.is_collective_heading(F.col("title")))
    return out.join(curation.select("ref"), "ref", "left_anti")


def drafts(found: DataFrame, most: int = 0) -> DataFrame:
    """Draft entries of candidates (0: of all), cut in input order before refs that occur twice collapse to the last."""
    order = [F.asc("session_ord"), F.asc("item_ord")]
    cut = found.orderBy(*order).limit(most) if most else found
    text = F.concat_ws(" ", known(F.col("title")), without_persons(F.col("suffix")), known(F.col("body")))
    row = F.struct(
        F.struct("session_ord", "item_ord").alias("at"), plain_title(F.col("title")).alias("title_plain"), F.lit("").alias("text_plain"),
        rules.tags(text, rules.LIFE_SITUATIONS).alias("life"), district_of(F.col("body")).alias("district"), F.array().cast("array<string>").alias("place"),
        rules.tags(text, rules.OCCASIONS).alias("occasion"), F.lit(True).alias("is_draft"),
    )
    last = cut.select("ref", row.alias("d")).groupBy("ref").agg(F.max("d").alias("d"), F.min("d.at").alias("first"))
    return last.select("ref", "d.title_plain", "d.text_plain", "d.life", "d.district", "d.place", "d.occasion", "d.is_draft", "first")


def draft_report(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("drafts"), F.count_if((F.size("life") == 0) & (F.size("occasion") == 0)).alias("without_tag"), F.count_if(F.size("district") == 0).alias("without_district"))


def upsert_ignore(existing: DataFrame, new: DataFrame, key: str = "ref") -> DataFrame:
    """existing, and the rows of new whose key is not there yet; existing rows never change."""
    added = new.join(existing.select(key), key, "left_anti")
    return existing.unionByName(added.select(*[c for c in existing.columns if c in new.columns]), allowMissingColumns=True)


def done_topics(curation: DataFrame, items: DataFrame) -> DataFrame:
    """Topics with a text; drafts carry a title only, so they are not done."""
    return curated_topics(curation.where(known(F.col("text_plain")) != ""), items).select("topic").distinct()


def _eligible(items: DataFrame, source: str) -> DataFrame:
    found = items.where((F.coalesce("source", F.lit("stadt")) == source) & ~rules.is_holding_body(F.col("body")))
    return found.where(F.col("is_public") & ~F.col("is_routine") & ~rules.is_short(F.col("title")) & ~rules.is_collective_heading(F.col("title")) & (F.trim("nr") != "Ö"))


def open_items(items: DataFrame, curation: DataFrame, source: str = "stadt") -> DataFrame:
    return _eligible(items, source).join(done_topics(curation, items), "topic", "left_anti")


def work_queue(items: DataFrame, curation: DataFrame, most: int = 25, source: str = "stadt") -> DataFrame:
    """The first topics without a text: topics with a decision stage first, later ones first, input order within ties (0: none).

    The topics are chosen by aggregates that combine before the shuffle; only the chosen ones' items are gathered.
    One row per topic: the lead appearance with all appearances, the main document and what was skipped.
    """
    decided, place = has_decision(F.col("stages")), F.struct("session_ord", "item_ord")
    order = [F.desc("decided"), F.desc(date_number(F.col("date_iso"))), F.asc("first")]
    topics = open_items(items, curation, source).groupBy("topic").agg(F.max(F.struct(decided.alias("decided"), "date_iso")).alias("lead"), F.min(place).alias("first"))
    chosen = topics.select("topic", "lead.*", "first").orderBy(*order).limit(most)
    # no item of a chosen topic is done
    found = _eligible(items, source).join(chosen.select("topic", "first"), "topic")
    one = F.struct("date_iso", "session_ord", "item_ord", "date_disp", "body")
    rank = F.struct(decided, F.col("date_iso"), (-F.col("session_ord")).alias("a"), (-F.col("item_ord")).alias("b"))
    lead = F.max_by(F.struct(*[c for c in items.columns if c != "topic"], decided.alias("decided")), rank).alias("lead")
    queue = found.groupBy("topic", "first").agg(lead, F.array_sort(F.collect_list(one)).alias("all")).select("topic", "lead.*", "first", "all").orderBy(*order)
    documents = rules.prioritised(rules.main_documents(F.col("documents")))
    return queue.withColumn("main", documents).select(
        "topic", "ref", "date_iso", "body", F.col("title").alias("official_title"), "proposal", "proposal_url", "applicant",
        F.transform("all", lambda a: F.struct(a["date_disp"].alias("date_disp"), a["body"].alias("body"))).alias("appearances"),
        (F.size("documents") - F.size("main")).alias("skipped"),
        F.get("main", F.lit(0))["title"].alias("document"), F.get("main", F.lit(0))["url"].alias("document_url"),
        F.when(F.size("main") == 0, "kein Hauptdokument").otherwise("").alias("note"), "decided", "first",
    )


def with_texts(queue: DataFrame, texts: DataFrame) -> DataFrame:
    """The batch: queue with (url, text, pages, note) of its main documents; PDF work is asked for these rows only."""
    got = texts.select(F.col("url").alias("document_url"), "text", "pages", F.col("note").alias("pdf_note"))
    out = queue.join(got, "document_url", "left")
    return out.withColumns({"text": F.coalesce("text", F.lit("")), "note": F.when(F.col("document").isNull(), F.col("note")).otherwise(F.coalesce("pdf_note", F.lit("")))}).drop("pdf_note")


def untagged(found: DataFrame, most: int = 12) -> DataFrame:
    """The first drafts for a report, in input order, with their labels or a mark that there are none."""
    labels = F.array_join(F.concat("life", "occasion"), ",")
    return found.orderBy("first").limit(most).select("ref", F.coalesce(F.get("district", F.lit(0)), F.lit("")).alias("district"), F.left("title_plain", F.lit(62)).alias("title"), F.when(labels == "", "— keine Schlagworte —").otherwise(labels).alias("labels"))


def batch_document(batch: DataFrame) -> DataFrame:
    """The batch as one JSON array in queue order: the queue is limited, so it fits one row."""
    names = [c for c in batch.columns if c not in ("decided", "first")]
    order = F.struct((~F.col("decided")).alias("later"), (-date_number(F.col("date_iso"))).alias("date"), "first")
    entries = batch.agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(*names).alias("entry")))).alias("all"))
    return entries.select(F.to_json(F.transform("all", lambda e: e["entry"]), {"ignoreNullFields": "false"}).alias("value"))


def batch_totals(batch: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long")
    return batch.agg(total.alias("characters"), F.count_if(F.col("text") == "").alias("without_text")).select("characters", approximate_tokens(F.col("characters")).alias("tokens"), "without_text")
