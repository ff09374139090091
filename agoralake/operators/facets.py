"""Faceted queries: AND across axes, OR within one, counts over all rows, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_date, known

# Texts above the results.
ALL_SHOWN, SOME_SHOWN, NONE_SHOWN = "Einträge — alle aufbereiteten Tagesordnungspunkte", "Einträgen passen zu Ihrer Auswahl", "Keine Einträge für diese Kombination. Filter weiter fassen?"

# Rows of the first page and of each further one.
FIRST_PAGE, NEXT_PAGE = 8, 20


def values_of(df: DataFrame, axis: str) -> Column:
    """An axis as an array: scalars become one-element arrays."""
    kind = dict(df.dtypes)[axis]
    return F.col(axis) if kind.startswith("array") else F.array(F.col(axis))


def matches(df: DataFrame, selection: dict[str, list]) -> Column:
    """Whether a row has, on every axis with chosen values, one of them."""
    def one(axis: str, chosen: list) -> Column:
        if dict(df.dtypes)[axis].startswith("array"):
            return F.arrays_overlap(F.col(axis), F.array(*map(F.lit, chosen)))
        return F.col(axis).isin(*chosen)  # reaches the scan

    return reduce(lambda a, b: a & b, [one(a, v) for a, v in selection.items() if v], F.lit(True))


def select(df: DataFrame, selection: dict[str, list]) -> DataFrame:
    return df.where(matches(df, selection))


def counts(df: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value, n) over all rows, whatever is selected; a row counts once for a value.  One pass for all axes."""
    def pairs_of(axis: str) -> Column:
        return F.transform(F.array_distinct(F.array_compact(values_of(df, axis))), lambda v: F.struct(F.lit(axis).alias("axis"), v.cast("string").alias("value")))

    pairs = [pairs_of(a) for a in axes]
    return df.select(F.explode(F.concat(*pairs)).alias("p")).groupBy("p.axis", "p.value").agg(F.count("*").alias("n"))


def page(df: DataFrame, order: list[Column], shown: int = FIRST_PAGE) -> DataFrame:
    return df.orderBy(*order).limit(shown)


def paging(hits: int, shown: int) -> tuple[int, int]:
    """(rows left, rows that the next step adds)."""
    left = max(0, hits - shown)
    return left, min(NEXT_PAGE, left)


def summary(df: DataFrame, selection: dict[str, list], shown: int = FIRST_PAGE) -> DataFrame:
    """hits, active (chosen values), shown, remaining and next of a selection."""
    active = sum(len(v) for v in selection.values())
    hits = select(df, selection).agg(F.count("*").alias("hits"))
    left = F.greatest(F.col("hits") - shown, F.lit(0))
    return hits.select("hits", F.lit(active).cast("long").alias("active"), F.least(F.col("hits"), F.lit(shown)).cast("long").alias("shown"), left.cast("long").alias("remaining"), F.least(left, F.lit(NEXT_PAGE)).cast("long").alias("next"))


def card_values(feed: DataFrame) -> DataFrame:
    """feed with the derived values of a card."""
    status = known(F.col("status"))
    badge = (status != "") & (status != "Ohne Vorlage")
    return feed.withColumns({
        "primary_url": F.coalesce(F.nullif("proposal_url", F.lit("")), F.col("session_url")),
        "badge": F.when(badge, status).otherwise(""),
        "badge_class": F.when(badge, F.lower(F.get(F.split(status, " "), F.lit(0)))).otherwise(""),
        "minutes_note": F.when(known(F.col("minutes_url")) != "", "link").when(status.startswith("Entscheidung"), "pending").otherwise(""),
        "draft_label": F.coalesce("is_draft", F.lit(False)),
    })


def cardinalities(feed: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, values): how many distinct values each axis has, 0 for an axis without any."""
    names = feed.sparkSession.createDataFrame([(a,) for a in axes], "axis string")
    found = counts(feed, axes).groupBy("axis").agg(F.count("*").alias("values"))
    return names.join(found, "axis", "left").select("axis", F.coalesce("values", F.lit(0)).cast("long").alias("values"))


def message(df: DataFrame, selection: dict[str, list]) -> DataFrame:
    """One row: the line above the results, and the one for a selection without results ('' where there are some)."""
    return message_of(df.agg(F.count("*").alias("total"), F.count_if(matches(df, selection)).alias("hits")), any(selection.values()))


def message_of(hits: DataFrame, chosen: bool) -> DataFrame:
    """The lines of one row (hits, total)."""
    every = F.concat_ws(" ", F.col("hits").cast("string"), F.lit(ALL_SHOWN))
    some = F.concat_ws(" ", F.col("hits").cast("string"), F.lit("von"), F.col("total").cast("string"), F.lit(SOME_SHOWN))
    none = F.when(F.col("hits") == 0, NONE_SHOWN).otherwise("")
    return hits.select((some if chosen else every).alias("line"), none.alias("empty"))


def provenance(statistics: DataFrame, prepared: DataFrame, registry: DataFrame, fetched: str, first: str, last: str) -> DataFrame:
    """One row: sources in order, date of the data, period, and how many of the items are prepared or left out."""
    names = registry.agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("names"))
    row = statistics.join(prepared.agg(F.count("*").alias("prepared"))).join(names)
    return row.select(F.concat(
        F.lit("Quellen: "), F.array_join(F.transform("names", lambda n: n["name"]), " · "),
        F.lit(" · Daten abgerufen am "), display_date(F.lit(fetched)), F.lit(f" · Zeitraum {first} bis {last} · Aufbereitet: "),
        F.col("prepared").cast("string"), F.lit(" von "), F.col("items").cast("string"), F.lit(" Tagesordnungspunkten ("), F.col("routine").cast("string"), F.lit(" Sitzungsroutine ausgelassen)."),
    ).alias("line"))


def headline(statistics: DataFrame, feed: DataFrame) -> DataFrame:
    """Sessions, items, prepared entries and districts in one row."""
    districts = feed.select(F.explode("district").alias("d")).agg(F.count_distinct("d").alias("districts"))
    return statistics.join(feed.agg(F.count("*").alias("prepared"))).join(districts).select("sessions", "items", "prepared", "districts")
