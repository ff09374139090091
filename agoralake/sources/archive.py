"""Archived pages as a data source of their own, and the crawl that reads nothing else.

An archive is a folder of Parquet files below source=/month=/host=, which
``write_archive`` makes of any table of pages.  ``spark.read.format("page_archive")`` reads
it with a partition for each host of a source and month (so a host's pages are
one task's, as its rate limit would be); filters on source, month and host leave
partitions out before any file is opened.  ``crawl_archive`` builds the calendar addresses
of its months, reads these pages, then asks for the sessions that they link in a
second scan, and for the stages of the proposals found there in a third.

The folder may be in any store that pyarrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import pages, records

FORMAT = "page_archive"
KEYS = ("source", "month", "host")
SCHEMA = "source string, month string, host string, path string, html string"
NOTHING = "__HIVE_DEFAULT_PARTITION__"

# Addresses of a portal's pages.
CALENDAR, SESSION, STAGES = "si0040.php?__cjahr={}&__cmonat={}&__canz=1&__cselect=0", "si0056.php?__ksinr=", "vo0053.php?__kvonr="

#: Comparisons on a key that a partition decides as a whole.
_DECIDES = {
    EqualTo: lambda value, bound: value == bound,
    In: lambda value, bounds: value in bounds,
    GreaterThan: lambda value, bound: value > bound,
    GreaterThanOrEqual: lambda value, bound: value >= bound,
    LessThan: lambda value, bound: value < bound,
    LessThanOrEqual: lambda value, bound: value <= bound,
}


@dataclass
class HostPages(InputPartition):
    """The files of one host of a source and month."""

    keys: tuple[str | None, ...]
    files: tuple[str, ...]


def _files(path: str):
    from pyarrow import fs

    if path.startswith("file:"):  # with one slash or three
        return fs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _DECIDES and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, keys: tuple[str | None, ...]) -> bool:
        at = dict(zip(KEYS, keys))
        # a comparison with a missing key is not true
        return all(at[f.attribute[0]] is not None and _DECIDES[type(f)](at[f.attribute[0]], f.value) for f in self.filters)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _files(self.path)
        by: dict[tuple, list[str]] = {}
        for found in system.get_file_info(fs.FileSelector(root, recursive=True)):
            *folders, name = found.path.split("/")
            if found.is_file and name.endswith(".parquet"):
                keys = tuple(unquote(x.partition("=")[2]) for x in folders[-len(KEYS) :])
                keys = tuple(None if k == NOTHING else k for k in keys)
                if self._wanted(keys):
                    by.setdefault(keys, []).append(found.path)
        found = [HostPages(k, tuple(sorted(v))) for k, v in sorted(by.items(), key=lambda x: tuple(k or "" for k in x[0]))]
        return found or [HostPages((None,) * len(KEYS), ())]  # a scan has one partition at least

    def read(self, partition: HostPages) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        system, _ = _files(self.path)
        if not partition.files:
            return
        for batch in ds.dataset(list(partition.files), filesystem=system, format="parquet").to_batches(columns=["path", "html"], batch_size=256):
            own = [pa.array([k] * batch.num_rows, pa.string()) for k in partition.keys]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(c).cast(pa.string()) for c in ("path", "html"))], names=[*KEYS, "path", "html"])


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def write_archive(found: DataFrame, path: str) -> None:
    """Pages (source, month 'YYYY-MM', host, path, html) as an archive; more pages can be appended."""
    found.select("path", "html", *KEYS).repartition(*KEYS).write.mode("append").partitionBy(*KEYS).parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's pages.  Filters reach a Python source only where the session allows it, which this sets."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageArchive)
    return spark.read.format(FORMAT).option("path", path).load()


def calendar_addresses(months: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, base_url, page_ord, month, path) of the calendar pages of months (year, month) in every source, in order of time."""
    year, month = F.col("year").cast("string"), F.col("month").cast("string")
    before, between, after = CALENDAR.split("{}")
    wanted = months.select((F.col("year") * 12 + F.col("month")).alias("page_ord"), F.concat(year, F.lit("-"), F.lpad(month, 2, "0")).alias("month"), F.concat(F.lit(before), year, F.lit(between), month, F.lit(after)).alias("path"))
    return wanted.crossJoin(F.broadcast(registry.select("source", "base_url")))  # a registry has a few rows


def _archived(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, path, ...) with the last html of the archive; pages that it lacks go."""
    return wanted.join(archive.groupBy("source", "path").agg(F.max_by("html", "month").alias("html")), ["source", "path"])


def crawl_archive(spark: SparkSession, path: str, registry: DataFrame, first: str | None, last: str | None, as_of: str, *, source: str = "beide", with_stages: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sessions, items) of the months from first to last of one source or both, from archived pages alone.

    Of a page that was archived in several months the last one counts.  with_stages: whether deliberation pages are read."""
    archive = records.chosen_sources(read_archive(spark, path), source)
    chosen = records.chosen_sources(registry, source)
    calendar = _archived(archive, calendar_addresses(records.months(spark, first, last, as_of), chosen)).select("source", "base_url", "page_ord", "html")
    sessions = archive.where(F.col("path").startswith(SESSION)).withColumn("session_id", F.regexp_extract("path", r"__ksinr=(\d+)", 1))
    fetched = sessions.groupBy("source", "session_id").agg(F.max_by("html", "month").alias("html"))
    linked = pages.session_pages(calendar, fetched)
    items = pages.parse_items(linked)
    asked = pages.stage_requests(items) if with_stages else pages.stage_requests(items).limit(0)
    wanted = asked.join(chosen.select("source", "base_url"), "source").withColumn("path", F.concat(F.lit(STAGES), "proposal_no"))
    stages = _archived(archive, wanted).select("source", "proposal_no", "base_url", "html")
    return pages.parse_sessions(linked), pages.attach_stages(items, stages)
