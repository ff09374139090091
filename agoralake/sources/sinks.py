"""Sinks: single JSON and script documents, batches, prompt bundles.  Nothing is written in place; paths are new folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import known


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named in spark.checkpoint.dir; only where that is unset (tests) in one beside the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def json_document(parts: DataFrame) -> DataFrame:
    """One row, one JSON text, of a one-row frame; see json_lines for more rows."""
    return parts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text per row, in the order of the rows."""
    return json_document(rows)


def script_document(parts: DataFrame, name: str = "window.FEED") -> DataFrame:
    """The JSON as a script that assigns it to a global."""
    return json_document(parts).select(F.concat(F.lit(f"{name} = "), "value", F.lit(";")).alias("value"))


def write_text(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("errorifexists").text(path)


def prompt_block(ref: Column, body: Column, date: Column, title: Column, suffix: Column, proposal: Column, draft: Column) -> Column:
    """A Markdown block of one open item; lines of missing values are left out."""
    line = lambda label, value: F.when(known(value) != "", F.concat(F.lit(f"- {label}: "), value))
    return F.concat_ws("\n", F.concat(F.lit("## "), ref), F.concat(F.lit("- Gremium: "), body, F.lit(" ("), date, F.lit(")")), F.concat(F.lit("- Amtlicher Titel: "), title), line("Zusatz", suffix), line("Vorlage", proposal), F.concat(F.lit("- Entwurf-Titel: "), draft), F.lit(""))
