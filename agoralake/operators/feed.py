"""The feed: one row per curated topic, its axes and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import date_number
from .status import STATUSES, derived
from .topics import appearances, best_versions, curated_topics, lead_appearances, minutes, own_appearance, ref_index

AXES = ("life", "district", "occasion")


def build_feed(sessions: DataFrame, items: DataFrame, curation: DataFrame, as_of: str) -> DataFrame:
    """Curation columns come from the winning ref, source columns from the lead appearance.

    Feed order is (date_iso descending, topic_ord); blank dates come last.
    """
    best = best_versions(curated_topics(curation, items))
    # topics without a proposal are the one item that was curated
    single = best.where("topic_key is null").select("ref").join(ref_index(items), "ref")
    grouped = items.where("topic_key is not null").join(best.where("topic_key is not null").select("topic_key").distinct(), "topic_key", "left_semi")
    lead = lead_appearances(grouped).unionByName(single.select(*grouped.columns))
    lead = lead.join(appearances(items), "topic", "left").withColumn("appearances", F.coalesce("appearances", own_appearance()))
    lead = lead.join(minutes(sessions), "session_url", "left")
    status = derived(F.col("proposal"), F.col("stages"), as_of)
    columns = lead.select(
        "topic", "appearances", status.alias("s"), F.coalesce("minutes_url", F.lit("")).alias("minutes_url"),
        "source", F.col("title").alias("official_title"), "nr", "proposal", "proposal_url", "applicant", "body", "code", "date_iso", "date_disp", "session_url", "documents", "stages",
    ).select("*", "s.status", "s.status_date").drop("s")
    chosen = best.select("ref", "topic", "title_plain", "text_plain", "title_easy", "text_easy", "life", "district", "occasion", "place", "is_draft", "topic_ord")
    return chosen.join(columns, "topic")


def ordered(feed: DataFrame) -> DataFrame:
    return feed.orderBy(F.desc("date_iso"), F.asc("topic_ord"))


def axis_values(feed: DataFrame, axis: str) -> DataFrame:
    """Distinct values of an array axis by code point."""
    return feed.select(F.explode(axis).alias("value")).distinct().orderBy("value")


def official_first(values: DataFrame, official: DataFrame) -> DataFrame:
    """(value, ord): values on the official list (value, ord) in its order, then the others by code point."""
    return values.join(official.select("value", "ord"), "value", "left").orderBy(F.asc_nulls_last("ord"), "value")


def statuses_present(feed: DataFrame) -> DataFrame:
    """Known statuses that occur, in their official order; unknown roles are no facet values."""
    order = feed.sparkSession.createDataFrame([(s, i) for i, s in enumerate(STATUSES)], "status string, ord int")
    return order.join(feed.select("status").distinct(), "status", "left_semi").orderBy("ord")


def status_distribution(feed: DataFrame) -> DataFrame:
    return feed.groupBy("status").agg(F.count("*").alias("n"))


def statistics(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count("*").alias("curated"), F.count_if("is_draft").alias("drafts"), F.count_if(F.col("text_easy") != "").alias("easy"), F.count_if(F.size("appearances") > 1).alias("several"))


def per_source(feed: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries of every source of the registry, 0 included."""
    counted = feed.groupBy("source").agg(F.count("*").alias("n"))
    return registry.select("source").join(counted, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def corpus_statistics(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Sessions, items, routine items, stages and public items."""
    s = sessions.agg(F.count("*").alias("sessions"))
    i = items.agg(F.count("*").alias("items"), F.count_if("is_routine").alias("routine"), F.coalesce(F.sum(F.size("stages")), F.lit(0)).alias("stages"), F.count_if("is_public").alias("public_items"))
    return s.join(i)


def source_statistics(sessions: DataFrame, items: DataFrame, registry: DataFrame) -> DataFrame:
    counts = sessions.groupBy("source").agg(F.count("*").alias("sessions")).join(items.groupBy("source").agg(F.count("*").alias("items")), "source", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return registry.select("source").join(counts, "source", "left").select("source", zero("sessions"), zero("items"))


def without_district(feed: DataFrame) -> DataFrame:
    return feed.where(F.size("district") == 0).select("ref")


def uncurated(items: DataFrame, curation: DataFrame) -> DataFrame:
    """Refs of public items that are no routine and not curated."""
    return ref_index(items).where("is_public and not is_routine").join(curation.select("ref"), "ref", "left_anti").select("ref")


def feed_entries(feed: DataFrame) -> DataFrame:
    """The feed in its order over all partitions, one row per entry; no row or task holds more than its range."""
    order = [F.desc(date_number(F.col("date_iso"))), F.asc("topic_ord")]
    return feed.repartitionByRange(*order).sortWithinPartitions(*order)


def feed_header(feed: DataFrame, header: dict[str, str]) -> DataFrame:
    """One small row: header and statistics."""
    return statistics(feed).select(*[F.lit(v).alias(k) for k, v in header.items()], F.struct("curated", "drafts", "easy").alias("statistics"))


def header_values(feed: DataFrame, sessions: DataFrame, items: DataFrame, registry: DataFrame, official_districts: DataFrame) -> DataFrame:
    """(axis, value, n, ord): everything that a header counts or lists, from one pass over the feed, one over sessions and one over items.

    ord is the official place of a district, status or source; those that do not occur have n 0."""
    pair = lambda axis, value: F.struct(F.lit(axis).alias("axis"), value.cast("string").alias("value"))
    counted = lambda name, when=None: F.array(pair("total", F.lit(name))) if when is None else F.when(when, F.array(pair("total", F.lit(name)))).otherwise(F.array().cast("array<struct<axis:string,value:string>>"))
    values = lambda axis: F.transform(axis, lambda v: pair(axis, v))
    entry = F.concat(*map(values, AXES), F.array(pair("status", F.col("status")), pair("source", F.col("source"))), counted("curated"), counted("drafts", F.col("is_draft")), counted("easy", F.col("text_easy") != ""))
    item = F.concat(counted("items"), counted("routine", F.col("is_routine")))
    seen = [df.select(F.explode(pairs).alias("p")) for df, pairs in ((feed, entry), (sessions, counted("sessions")), (items, item))]
    seen = seen[0].unionByName(seen[1]).unionByName(seen[2]).select("p.*", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("ord"))
    known_ = lambda df, axis, value: df.select(F.lit(axis).alias("axis"), F.col(value).cast("string").alias("value"), F.lit(0).cast("long").alias("n"), F.col("ord").cast("long").alias("ord"))
    statuses = F.explode(F.array(*[F.struct(F.lit(s).alias("value"), F.lit(i).alias("ord")) for i, s in enumerate(STATUSES)]))
    statuses = feed.sparkSession.range(1).select(statuses.alias("s")).select("s.*")
    every = seen.unionByName(known_(registry, "source", "source")).unionByName(known_(official_districts, "district", "value")).unionByName(known_(statuses, "status", "value"))
    return every.groupBy("axis", "value").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"))


def full_header(feed: DataFrame, sessions: DataFrame, items: DataFrame, registry: DataFrame, official_districts: DataFrame, header: dict[str, str]) -> DataFrame:
    """One row: header, statistics of corpus and feed (with entries per source and status), and the values of all axes in their order."""
    found = header_values(feed, sessions, items, registry, official_districts)
    axis, occurs = F.col("axis"), F.col("n") > 0
    total = lambda name: F.coalesce(F.sum(F.when((axis == "total") & (F.col("value") == name), F.col("n"))), F.lit(0)).cast("long").alias(name)
    counts = lambda name, when: F.map_from_entries(F.array_sort(F.collect_list(F.when((axis == name) & when, F.struct("value", "n")))))
    place = F.coalesce("ord", F.lit(1 << 30))
    listed = lambda name, when=occurs: F.transform(F.array_sort(F.collect_list(F.when((axis == name) & when, F.struct(place.alias("ord"), F.col("value").alias("v"))))), lambda s: s["v"])
    row = found.agg(
        *[total(c) for c in ("sessions", "items", "routine", "curated", "drafts", "easy")],
        counts("source", F.col("ord").isNotNull()).alias("per_source"),
        counts("status", occurs).alias("status"),
        *[listed(a).alias(a) for a in AXES],
        listed("status", occurs & F.col("ord").isNotNull()).alias("statuses"),
    )
    return row.select(
        *[F.lit(v).alias(k) for k, v in header.items()],
        F.struct("sessions", "items", "routine", "curated", "drafts", "easy", "per_source", "status").alias("statistics"),
        F.struct("life", "district", "occasion", "statuses").alias("axes"),
    )


def feed_document(feed: DataFrame, header: dict[str, str], most_bytes: int = 1 << 28) -> DataFrame:
    """One row: header, statistics and the entries in feed order.  For small feeds: one of more than most_bytes is refused, feed_header and feed_entries have any size."""
    size = feed.select(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    if size > most_bytes:
        raise ValueError(f"a feed of {size} bytes is no single document; use feed_header and feed_entries")
    entries = feed.agg(F.array_sort(F.collect_list(F.struct((-F.coalesce(F.regexp_replace("date_iso", "-", "").try_cast("long"), F.lit(0))).alias("o"), "topic_ord", F.struct(*feed.columns).alias("entry")))).alias("all"))
    return statistics(feed).join(entries).select(*[F.lit(v).alias(k) for k, v in header.items()], F.struct("curated", "drafts", "easy").alias("statistics"), F.transform("all", lambda e: e["entry"]).alias("entries"))
