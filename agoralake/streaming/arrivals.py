"""Facts that arrive late, by state of their own key: a batch meets what it brings, not the table.

``first_arrivals`` lets the first row of each key through and no later one, whatever
batch it comes in: a key's state says that it was there.  ``late_minutes`` pairs sessions with
minutes that are published weeks later, in either order of arrival.  State is kept in the
store that ``ROCKS_DB`` names, since keys stay for good; it and the sink commit batch by
batch, so a batch that is replayed after a failure adds nothing twice.

Order within a batch is that of an order column, then of the whole row as text.  Rows without
a key go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that keyed state needs.
ROCKS_DB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FirstArrival(StatefulProcessor):
    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getValueState("there", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        first = None
        if not self.there.exists():
            for part in rows:  # one row is kept of however many
                part = part if first is None else pd.concat([first, part], ignore_index=True)
                told = part.assign(_order=part[self.order], _row=part.astype(str).agg("\x1f".join, axis=1))
                first = part.loc[[told.sort_values(["_order", "_row"], kind="stable").index[0]]]
            self.there.update((True,))
        yield first if first is not None else pd.DataFrame()

    def close(self) -> None:
        pass


class LateMinutes(StatefulProcessor):
    """Rows (session_url, kind 'session' or 'minutes', minutes_url, order) of one session to (session_url, minutes_url)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "there boolean")
        self.minutes = handle.getValueState("minutes", "url string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = self.session.exists()
        paired = known and self.minutes.exists()
        best = None
        for part in rows:
            known = known or bool((part["kind"] == "session").any())
            found = part[(part["kind"] == "minutes") & part["minutes_url"].notna()]
            if len(found):
                low = min(zip(found["order"], found["minutes_url"]))
                best = low if best is None else min(best, low)
        if known:
            self.session.update((True,))
        if best is not None and not self.minutes.exists():
            self.minutes.update((best[1],))
        if known and not paired and self.minutes.exists():
            yield pd.DataFrame({"session_url": [key[0]], "minutes_url": [self.minutes.get()[0]]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def _with_state(spark: SparkSession) -> None:
    spark.conf.set(*ROCKS_DB)


def first_arrivals(arrivals: DataFrame, key: str = "ref", order: str = "arrived") -> DataFrame:
    """The stream's rows that are the first of their key, over all batches; its columns stay."""
    _with_state(arrivals.sparkSession)
    rows = arrivals.where(F.col(key).isNotNull())
    return rows.groupBy(key).transformWithStateInPandas(FirstArrival(order), outputStructType=rows.schema, outputMode="append", timeMode="none")


def late_minutes(sessions: DataFrame, minutes: DataFrame) -> DataFrame:
    """(session_url, minutes_url), once for each session, as soon as both have arrived; of several minutes the first in order counts.

    sessions: a stream with session_url; minutes: one of (session_url, minutes_url, order)."""
    _with_state(sessions.sparkSession)
    known = sessions.select("session_url", F.lit("session").alias("kind"), F.lit(None).cast("string").alias("minutes_url"), F.lit(None).cast("long").alias("order"))
    found = minutes.select("session_url", F.lit("minutes").alias("kind"), "minutes_url", F.col("order").cast("long").alias("order"))
    rows = known.unionByName(found).where("session_url is not null")
    return rows.groupBy("session_url").transformWithStateInPandas(LateMinutes(), outputStructType="session_url string, minutes_url string", outputMode="append", timeMode="none")


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The stream as Parquet files at path; a batch is written once, however often it is tried."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
