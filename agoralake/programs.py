"""The five programs end to end: crawl, drafts, feed, work queue, check.  Inputs and outputs are paths; nothing is overwritten.

A corpus and a feed are folders or documents (see sources.documents), a curation is one
document: it is what people write by hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import feed as feeds
from .operators import quality, worklist
from .sources import archive, documents, records, sinks
from .sources.records import DOCUMENTS, STAGES

# Fixed value: what a raw corpus says of its pages.
NOTE = "Oeffentlich zugaengliche Seiten, ohne Anmeldung abgerufen."

_ITEM = ("nr", "title", "suffix", "applicant", "addendum", "is_public", "is_routine", "proposal", "proposal_url", "documents", "stages")


def with_items(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Sessions with the array of their items, by date and code, latest first; session_ord is numbered by that order."""
    one = F.struct("item_ord", *_ITEM)
    own = items.groupBy("source", "session_id").agg(F.array_sort(F.collect_list(one)).alias("items"))
    empty = F.array().cast(f"array<struct<item_ord:bigint,nr:string,title:string,suffix:string,applicant:string,addendum:string,is_public:boolean,is_routine:boolean,proposal:string,proposal_url:string,documents:{DOCUMENTS},stages:{STAGES}>>")
    joined = sessions.join(own, ["source", "session_id"], "left").withColumn("items", F.coalesce("items", empty))
    # ids grow along a sort, over all its partitions
    return joined.orderBy(F.desc("date_iso"), F.desc("code"), "source", "session_ord").withColumn("session_ord", F.monotonically_increasing_id())


def crawl(spark: SparkSession, archived: str, out: str, registry: DataFrame, as_of: str, *, first: str | None = None, last: str | None = None, source: str = "beide", with_stages: bool = True, note: str = NOTE) -> DataFrame:
    """Archived pages of the months (the last three by default) to a raw corpus at out; returns sessions and items of each source."""
    sessions, items = archive.crawl_archive(spark, archived, registry, first, last, as_of, source=source, with_stages=with_stages)
    documents.write_rows(documents.own_sessions(with_items(sessions, items)), out)
    stored = documents.read_sessions(spark, out)
    span = records.months(spark, first, last, as_of).agg(F.min(F.struct("year", "month")).alias("a"), F.max(F.struct("year", "month")).alias("b")).first()
    name = lambda m, given: given or (f"{m['year']}-{m['month']:02d}" if m else "")
    chosen = records.chosen_sources(registry, source)
    routine = F.transform("items", lambda t: F.struct(F.coalesce(t["verfahren"], F.lit(False)).alias("is_routine")))
    documents.write_head(documents.raw_head(stored.withColumn("items", routine), chosen, note, as_of, name(span["a"], first), name(span["b"], last)), out)
    return feeds.source_statistics(stored, records.items_of(stored), chosen)


@dataclass
class Corpus:
    """What the other programs read."""

    sessions: DataFrame
    items: DataFrame
    curation: DataFrame
    vocabulary: DataFrame


def load(spark: SparkSession, raw: str, curation: str) -> Corpus:
    sessions = documents.read_sessions(spark, raw)
    told = records.read_json(spark, curation, records.CURATION_SCHEMA)
    return Corpus(sessions, records.items_of(sessions), records.curation_of(told), records.vocabulary_of(told))


def drafts(spark: SparkSession, raw: str, curation: str, out: str | None, *, source: str | None = None, most: int = 0, holding: bool = False, prompts: str | None = None) -> DataFrame:
    """Draft entries of uncurated items, added to the curation document as out (None: a dry run); returns the drafts.

    prompts: where a prompt bundle of the open items is written, if anywhere."""
    corpus = load(spark, raw, curation)
    found = worklist.candidates(corpus.items, corpus.curation, source, holding)
    made = worklist.drafts(found, most)
    if out is not None:
        last = F.lit((corpus.curation.agg(F.max("cur_ord").alias("n")).first()["n"] or 0) + 1)
        place = F.row_number().over(Window.orderBy("first")).cast("long") + last  # a curation is one document
        new = made.select("ref", "title_plain", "text_plain", F.lit("").alias("title_easy"), F.lit("").alias("text_easy"), "life", "district", "place", "occasion", "is_draft", place.alias("cur_ord"))
        documents.curation_document(worklist.upsert_ignore(corpus.curation, new), corpus.vocabulary).write.text(out)
    if prompts is not None:
        block = sinks.prompt_block(F.col("ref"), F.col("body"), F.col("date_disp"), F.col("title"), F.col("suffix"), F.col("proposal"), F.col("title_plain"))
        rows = found.join(made.select("ref", "title_plain"), "ref").orderBy("session_ord", "item_ord").select(block.alias("value"))
        rows.write.text(prompts)
    return made


def feed(spark: SparkSession, raw: str, curation: str, out: str, registry: DataFrame, as_of: str, city: str) -> DataFrame:
    """The feed at out; returns its head's statistics and axes in one row."""
    corpus = load(spark, raw, curation)
    documents.write_rows(documents.own_entries(feeds.build_feed(corpus.sessions, corpus.items, corpus.curation, as_of)), out)
    stored = documents.read_feed(spark, out)
    official = corpus.vocabulary.where("axis = 'district'").select("value", "ord")
    row = feeds.full_header(stored, corpus.sessions, corpus.items, registry, official, {})
    documents.write_head(documents.own_head(row, documents.read_raw_head(spark, raw), city, as_of), out)
    return row


def queue(spark: SparkSession, raw: str, curation: str, *, most: int = 25, source: str = "stadt", texts: DataFrame | None = None) -> DataFrame:
    """The next topics without a text; with texts (url, text, pages, note) of their main documents, the batch."""
    corpus = load(spark, raw, curation)
    found = worklist.work_queue(corpus.items, corpus.curation, most, source)
    return found if texts is None else worklist.with_texts(found, texts)


@dataclass
class Checked:
    coverage: DataFrame
    violations: DataFrame
    #: 0 in order, 1 not.
    verdict: int


def check(spark: SparkSession, raw: str, curation: str, feed_path: str, out: str, *, strict: bool = False) -> Checked:
    """All checks of a corpus, its curation and its feed; the violations are written to out."""
    corpus, stored = load(spark, raw, curation), documents.read_feed(spark, feed_path)
    found, seen = quality.observed(quality.violations(corpus.curation, corpus.items, stored, corpus.vocabulary))
    found.write.parquet(out)
    return Checked(quality.coverage_report(corpus.items, stored), spark.read.schema(found.schema).parquet(out), quality.observed_verdict(seen, strict))
