"""Keys, topics, lead appearances and the best curated version of a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import known

DECISION = "Entscheidung"


def ref_key(source: Column, session_id: Column, nr: Column) -> Column:
    return F.concat(source, F.lit(":"), session_id, F.lit("#"), nr)


def topic_key(source: Column, proposal_url: Column) -> Column:
    """source:vorlage:number of the proposal, null without one."""
    number = F.regexp_extract(known(proposal_url), r"__kvonr=(\d+)", 1)
    return F.when(number != "", F.concat(source, F.lit(":vorlage:"), number))


def with_keys(items: DataFrame) -> DataFrame:
    """items with ref, topic_key (null without a proposal) and topic (the key, or else the ref)."""
    keyed = items.withColumns({"ref": ref_key(F.col("source"), F.col("session_id"), F.col("nr")), "topic_key": topic_key(F.col("source"), F.col("proposal_url"))})
    return keyed.withColumn("topic", F.coalesce("topic_key", "ref"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order (which must break all ties)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def ref_index(items: DataFrame) -> DataFrame:
    """One item per ref: of items that share a ref the last in input order."""
    return first_by(items, ["ref"], F.desc("session_ord"), F.desc("item_ord"))


def has_decision(stages: Column) -> Column:
    """Whether a stage's role starts with a decision."""
    return F.coalesce(F.exists(stages, lambda s: s["role"].startswith(DECISION)), F.lit(False))


def appearances(items: DataFrame) -> DataFrame:
    """(topic, appearances): every item of a topic, public or not, by session date, blank dates first, input order within ties."""
    one = F.struct("date_iso", "session_ord", "item_ord", "date_disp", "body", "nr", "session_url")
    grouped = items.where("topic_key is not null").groupBy(F.col("topic_key").alias("topic")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.select("topic", _shown(F.col("all")).alias("appearances"))


def _shown(found: Column) -> Column:
    return F.transform(found, lambda a: F.struct(a["date_iso"].alias("date_iso"), a["date_disp"].alias("date_disp"), a["body"].alias("body"), a["nr"].alias("nr"), a["session_url"].alias("session_url")))


def own_appearance() -> Column:
    return F.array(F.struct("date_iso", "date_disp", "body", "nr", "session_url"))


def lead_appearances(items: DataFrame, key: str = "topic") -> DataFrame:
    """The item that stands for each topic: of those with a decision stage, else of all, the latest; the first in input order within ties."""
    return first_by(items.where(F.col(key).isNotNull()), [key], F.desc(has_decision(F.col("stages"))), F.desc("date_iso"), F.asc("session_ord"), F.asc("item_ord"))


def quality(cur: dict[str, Column] | None = None) -> Column:
    """How complete a curated version is: no draft, easy text, text, number of labels; compares from left to right."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(yes(~F.col("is_draft")).alias("final"), yes(known(F.col("text_easy")) != "").alias("easy"), yes(known(F.col("text_plain")) != "").alias("text"), (F.size("life") + F.size("occasion")).alias("labels"))


def curated_topics(curation: DataFrame, items: DataFrame) -> DataFrame:
    """Curated entries with the topic of their item (entries without one go)."""
    return curation.join(ref_index(items).select("ref", "topic", "topic_key"), "ref")


def best_versions(curated: DataFrame) -> DataFrame:
    """The best version of each topic, the earlier of equal ones, at the topic's first position (topic_ord)."""
    # a maximum combines before the shuffle, so a topic with most of the rows is no large task
    best = F.max(F.struct(quality().alias("quality"), (-F.col("cur_ord")).alias("earlier"), F.struct(*curated.columns).alias("row")))
    return curated.groupBy("topic").agg(best.alias("_best"), F.min("cur_ord").alias("topic_ord")).select("_best.row.*", "topic_ord")


def merged_versions(curated: DataFrame) -> DataFrame:
    """(topic, ref) of versions that lost to another one of their topic."""
    return curated.select("topic", "ref").join(best_versions(curated).select("ref"), "ref", "left_anti").select("topic", "ref")


def orphans(curation: DataFrame, items: DataFrame) -> DataFrame:
    """Curated refs without an item."""
    return curation.join(items.select("ref"), "ref", "left_anti").select("ref", "cur_ord")


def minutes(sessions: DataFrame) -> DataFrame:
    """(session_url, minutes_url): the first document of each session whose title names minutes; the last session of a URL counts."""
    found = F.filter("session_documents", lambda d: d["title"].rlike("(?iU)niederschrift"))
    have = sessions.where(F.size(found) > 0).select("session_url", F.get(found, F.lit(0))["url"].alias("minutes_url"), "session_ord")
    return first_by(have, ["session_url"], F.desc("session_ord")).select("session_url", "minutes_url")
