"""The data contract: violations of curation and feed, and a coverage report that leaves no item unexplained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import known
from .topics import orphans

ERROR, WARNING = "error", "warning"
MOST_WORDS = 14

# Reasons of the coverage report, in the order they are tried.
REASONS = ("im Feed", "nicht oeffentlich", "Sitzungsroutine", "Aufsichtsrat/Zweckverband", "Titel zu kurz", "Sammelueberschrift", "NOCH NICHT AUFBEREITET")


def _violations(rows: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "ref", detail.cast("string").alias("detail"))


def dangling(curation: DataFrame, items: DataFrame) -> DataFrame:
    return _violations(orphans(curation, items), "reference", ERROR, F.col("ref"))


def lost_easy_texts(curation: DataFrame, feed: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """Easy texts that are not in the feed.

    As written, any other easy entry of the feed silences the check; with curated
    (ref, topic) it is strict: the entry of the same topic must have an easy text.
    """
    lost = curation.where(known(F.col("text_easy")) != "").join(feed.select("ref"), "ref", "left_anti")
    easy = feed.where(known(F.col("text_easy")) != "")
    if curated is None:
        lost = lost.join(easy.select(F.lit(1).alias("x")).limit(1), F.lit(True), "left_anti")
    else:
        lost = lost.join(curated.select("ref", "topic"), "ref", "left").join(easy.select("topic").distinct(), "topic", "left_anti")
    return _violations(lost, "loss", ERROR, F.col("ref"))


def duplicate_topics(feed: DataFrame) -> DataFrame:
    twice = feed.groupBy("topic").agg(F.count("*").alias("n")).where("n > 1").withColumn("ref", F.col("topic"))
    return _violations(twice, "duplicate topic", ERROR, F.col("n"))


def unknown_values(curation: DataFrame, vocabulary: DataFrame, axes: tuple[str, ...] = ("life", "district", "occasion")) -> DataFrame:
    def pairs_of(axis: str) -> Column:
        return F.transform(axis, lambda v: F.struct(F.lit(axis).alias("axis"), v.alias("value")))

    used = curation.select("ref", F.explode(F.concat(*map(pairs_of, axes))).alias("u")).select("ref", "u.*").distinct()
    bad = used.join(vocabulary.select("axis", "value"), ["axis", "value"], "left_anti")
    return _violations(bad, "vocabulary", ERROR, F.concat_ws("=", "axis", "value"))


def required_fields(curation: DataFrame) -> DataFrame:
    blank = curation.where(F.trim(F.regexp_replace(known(F.col("title_plain")), r"(?U)\s", " ")) == "")
    untitled = curation.where((known(F.col("text_easy")) != "") & (known(F.col("title_easy")) == ""))
    return _violations(blank, "required", ERROR, F.lit("title_plain")).unionByName(_violations(untitled, "required", WARNING, F.lit("title_easy")))


def asserted_outcomes(curation: DataFrame) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("field"), rules.asserted_outcome(F.col(f)).alias("phrase")) for f in ("text_plain", "text_easy")])
    bad = curation.select("ref", F.explode(fields).alias("x")).select("ref", "x.*").where("phrase <> ''")
    return _violations(bad, "outcome", ERROR, F.concat_ws(": ", "field", "phrase"))


def long_sentences(curation: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    each = curation.select("ref", F.explode(F.split(known(F.col("text_easy")), "[.!?]")).alias("sentence"))
    each = each.withColumn("sentence", F.regexp_replace("sentence", r"(?U)^\s+|\s+$", "")).where("sentence <> ''")
    long_ = each.withColumn("words", F.size(F.split("sentence", r"(?U)\s+"))).where(F.col("words") > most)
    return _violations(long_, "sentence", WARNING, F.concat_ws(": ", "words", F.left("sentence", F.lit(52))))


def _curation_findings(vocabulary_axes: tuple[str, ...]) -> Column:
    """array<struct<check, severity, detail>> of one curated row that knows in_items, in_feed, easy_in_feed and allowed (axis to values)."""
    empty = F.array().cast("array<struct<check:string,severity:string,detail:string>>")
    one = lambda check, severity, detail: F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    some = lambda when, *found: F.when(when, F.array(*found)).otherwise(empty)
    easy = known(F.col("text_easy")) != ""
    blank = F.trim(F.regexp_replace(known(F.col("title_plain")), r"(?U)\s", " ")) == ""

    def unknown(axis: str) -> Column:
        used = F.array_except(F.array_compact(F.col(axis)), F.coalesce(F.col("allowed")[axis], F.array().cast("array<string>")))
        return F.transform(used, lambda v: one("vocabulary", ERROR, F.concat(F.lit(f"{axis}="), v)))

    def outcome(field: str) -> Column:
        phrase = rules.asserted_outcome(F.col(field))
        return some(phrase != "", one("outcome", ERROR, F.concat(F.lit(f"{field}: "), phrase)))

    sentences = F.transform(F.split(known(F.col("text_easy")), "[.!?]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    counted = F.transform(sentences, lambda x: F.struct(x.alias("text"), F.when(x == "", 0).otherwise(F.size(F.split(x, r"(?U)\s+"))).alias("words")))
    long_ = F.transform(F.filter(counted, lambda x: x["words"] > MOST_WORDS), lambda x: one("sentence", WARNING, F.concat_ws(": ", x["words"].cast("string"), F.left(x["text"], F.lit(52)))))
    return F.concat(
        some(~F.col("in_items"), one("reference", ERROR, F.col("ref"))),
        some(easy & ~F.col("in_feed") & ~F.col("easy_in_feed"), one("loss", ERROR, F.col("ref"))),
        *map(unknown, vocabulary_axes),
        some(blank, one("required", ERROR, F.lit("title_plain"))),
        some(easy & (known(F.col("title_easy")) == ""), one("required", WARNING, F.lit("title_easy"))),
        outcome("text_plain"),
        outcome("text_easy"),
        long_,
    )


def violations(curation: DataFrame, items: DataFrame, feed: DataFrame, vocabulary: DataFrame, axes: tuple[str, ...] = ("life", "district", "occasion")) -> DataFrame:
    """All checks in one scan of the curation; none stops another.  Each row gives an array of what is wrong with it.

    Of the feed only refs, and whether any entry has an easy text, are asked; its duplicate topics are a count of their own."""
    refs = lambda df, name: df.select("ref", F.lit(True).alias(name)).distinct()
    # two frames of one row each
    allowed = vocabulary.groupBy("axis").agg(F.collect_set("value").alias("values")).agg(F.map_from_entries(F.collect_list(F.struct("axis", "values"))).alias("allowed"))
    easy = feed.agg(F.coalesce(F.bool_or(known(F.col("text_easy")) != ""), F.lit(False)).alias("easy_in_feed"))
    told = curation.join(refs(items, "in_items"), "ref", "left").join(refs(feed, "in_feed"), "ref", "left").join(F.broadcast(allowed)).join(F.broadcast(easy))
    told = told.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_items", "in_feed")})
    found = told.select("ref", F.explode(_curation_findings(axes)).alias("v")).select("v.check", "v.severity", "ref", "v.detail")
    return found.unionByName(duplicate_topics(feed))


def observed(found: DataFrame) -> tuple[DataFrame, Observation]:
    """found, and what will be known of it once it is written: errors and warnings."""
    seen = Observation()
    return found.observe(seen, F.count_if(F.col("severity") == ERROR).alias(ERROR), F.count_if(F.col("severity") == WARNING).alias(WARNING)), seen


def observed_verdict(seen: Observation, strict: bool = False) -> int:
    """The verdict without a second job."""
    n = seen.get
    return int(n[ERROR] > 0 or strict and n[WARNING] > 0)


def samples(found: DataFrame, most: int = 5) -> DataFrame:
    """For each check how many violations there are, and the first refs."""
    rank = F.row_number().over(Window.partitionBy("check", "severity").orderBy("ref", "detail"))
    first = found.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("check", "severity").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("ref").cast("string").alias("ref")))).alias("refs"))
    counts = found.groupBy("check", "severity").agg(F.count("*").alias("n"))
    return counts.join(first, ["check", "severity"]).select("check", "severity", "n", F.array_join(F.transform("refs", lambda r: r["ref"]), ", ").alias("refs"))


def by_ref_or_topic(items: DataFrame, feed: DataFrame) -> DataFrame:
    """items and whether their ref, or their topic, is in the feed."""
    by_ref = feed.select("ref", F.lit(True).alias("in_ref")).distinct()
    by_topic = feed.select("topic", F.lit(True).alias("in_topic")).distinct()
    flagged = items.join(by_ref, "ref", "left").join(by_topic, "topic", "left")
    return flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_ref", "in_topic")})


def verdict(found: DataFrame, strict: bool = False) -> int:
    """0 in order, 1 not: any error, or (strict) any warning."""
    n = {r["severity"]: r["count"] for r in found.groupBy("severity").count().collect()}
    return int(n.get(ERROR, 0) > 0 or strict and n.get(WARNING, 0) > 0)


def coverage(items: DataFrame, feed: DataFrame) -> DataFrame:
    """Items with the first reason that explains why they are in the feed or not."""
    flagged = by_ref_or_topic(items, feed)
    title = F.col("title")
    reason = (
        F.when(F.col("in_ref") | F.col("in_topic"), REASONS[0]).when(~F.col("is_public"), REASONS[1]).when(F.col("is_routine"), REASONS[2])
        .when(rules.is_holding_body(F.col("body")), REASONS[3]).when(rules.is_short(title), REASONS[4]).when(rules.is_collective_heading(title), REASONS[5]).otherwise(REASONS[6])
    )
    return flagged.withColumn("reason", reason)


def coverage_report(items: DataFrame, feed: DataFrame) -> DataFrame:
    """(reason, n), the most frequent first, the first met within ties."""
    found = coverage(items, feed).groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct("session_ord", "item_ord")).alias("first"))
    return found.orderBy(F.desc("n"), F.asc("first"))
