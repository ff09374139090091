"""Small helpers shared by the operators: column naming, Arrow schemas, settings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def numbered(docs: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: no name of an extra column can clash with ours."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def position(docs: DataFrame, name: str) -> str:
    """The numbered name of a column."""
    return f"c{docs.columns.index(name)}"


def text_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long) and text (string) only; extra columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added, or replaced where the name is there already."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only where that is unset (tests) one below the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def freed(df: DataFrame) -> DataFrame:
    """The same rows for one action, at whose end the files of its shuffles go; else they stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*")  # Spark reads the setting as a frame is made
    finally:
        conf.set(FREE_SHUFFLES, before)


@contextmanager
def row_by_row(spark: SparkSession) -> Iterator[None]:
    """Frames that run within get their rows in Python one at a time."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "1")
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives lost executors, frees the disk of its shuffles."""
    checkpoint_dir(df.sparkSession)
    return freed(df).checkpoint(eager=True)
