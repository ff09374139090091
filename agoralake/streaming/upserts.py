"""Late facts as a stream: items and curated entries that arrive later are upserted, existing rows never change."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def insert_only(arrivals: DataFrame, path: str, checkpoint: str, key: str = "ref", trigger: dict | None = None) -> StreamingQuery:
    """Append to the table at path, per micro-batch, one row of each key that is not there yet (any of several in a batch).

    Each batch reads the table's keys; arrivals.first_arrivals meets the batch's own keys only, and keeps the first.

    A batch that is replayed after a failure adds nothing twice, since its keys are there by then.
    """
    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            there = batch.sparkSession.read.schema(batch.schema).parquet(path).select(key)
            new = new.join(there, key, "left_anti").select(*batch.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        new.write.mode("append").parquet(path)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
