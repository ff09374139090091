"""The data source of archived pages and the crawl over it."""

import pytest
from pyspark.sql import functions as F

from agoralake.sources import archive, pages, records

from .test_agenda import SESSION, STAGES


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "pages")
    calendar = "si0056.php?__ksinr=9 si0056.php?__ksinr=7"
    rows = [
        ("stadt", "2026-05", "b", archive.CALENDAR.format(2026, 5), calendar),
        ("stadt", "2026-06", "b", archive.CALENDAR.format(2026, 6), "si0056.php?__ksinr=7 si0056.php?__ksinr=1"),
        ("stadt", "2026-08", "b", archive.CALENDAR.format(2026, 8), "si0056.php?__ksinr=2"),
        ("stadt", "2026-05", "b", "si0056.php?__ksinr=7", ""),  # archived again later
        ("stadt", "2026-06", "b", "si0056.php?__ksinr=7", SESSION),
        ("stadt", "2026-06", "b", "si0056.php?__ksinr=9", ""),
        ("stadt", "2026-08", "b", "si0056.php?__ksinr=2", SESSION),
        ("stadt", "2026-06", "b", "vo0053.php?__kvonr=42", STAGES),
        ("bza", "2026-06", "c:8080", archive.CALENDAR.format(2026, 6), "si0056.php?__ksinr=7"),
        ("bza", "2026-06", "c:8080", "si0056.php?__ksinr=7", SESSION),
        ("bza", None, "c:8080", "other", None),
    ]
    archive.write_archive(spark.createDataFrame(rows, f"{archive.SCHEMA}"), path)
    return path, rows


def test_every_page_is_read(spark, stored):
    path, rows = stored
    assert sorted(map(repr, map(tuple, archive.read_archive(spark, path).collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize(
    ("condition", "kept", "partitions"),
    [("source = 'bza'", 3, 2), ("source = 'stadt' and month >= '2026-06'", 6, 2), ("month in ('2026-05', '2026-08') and host = 'b'", 4, 2), ("month < '2026-06'", 2, 1), ("source = 'none'", 0, 1), ("path like 'vo%'", 1, 5), ("month is null", 1, 5), ("source = 'bza' or month = '2026-05'", 5, 5)],
)
def test_filters_leave_partitions_out(spark, stored, condition, kept, partitions):
    found = archive.read_archive(spark, stored[0]).where(condition)
    assert found.count() == kept and found.rdd.getNumPartitions() == partitions


def test_files_of_other_partitions_are_not_opened(spark, stored, tmp_path):
    import shutil
    from pathlib import Path

    shutil.copytree(stored[0], tmp_path / "broken")
    for f in Path(tmp_path / "broken/source=stadt").rglob("*.parquet"):
        f.write_bytes(b"no parquet")
    read = archive.read_archive(spark, str(tmp_path / "broken"))
    assert read.where("source = 'bza'").count() == 3
    with pytest.raises(Exception):  # noqa: B017
        read.where("source = 'stadt'").count()


def test_a_crawl_from_calendar_to_stages(spark, stored):
    registry = records.source_registry(spark, {"stadt": ("Stadt", "http://b"), "bza": ("BZA", "http://c")})
    crawl = lambda **more: archive.crawl_archive(spark, stored[0], registry, "2026-05", "2026-07", "2026-07-01", **more)
    sessions, items = crawl()
    # 9 is empty, 1 is not archived, 2 is linked in August only
    assert sorted((r["source"], r["session_id"]) for r in sessions.collect()) == [("bza", "7"), ("stadt", "7")]
    told = {(r["source"], r["nr"]): len(r["stages"]) for r in items.collect()}
    assert told[("stadt", "Ö 1.7")] == 2 and told[("bza", "Ö 1.7")] == 0
    plain = {(r["source"], r["nr"]): len(r["stages"]) for r in crawl(source="stadt", with_stages=False)[1].collect()}
    assert plain == {k: 0 for k in told if k[0] == "stadt"}
    assert archive.crawl_archive(spark, stored[0], registry, "2026-07", "2026-05", "2026-07-01")[0].count() == 0


def test_calendar_addresses(spark):
    registry = records.source_registry(spark, {"a": ("A", "http://a")})
    found = archive.calendar_addresses(records.months(spark, "2025-12", "2026-01", "2026-01-01"), registry).orderBy("page_ord")
    assert [(r["month"], r["path"], r["base_url"]) for r in found.collect()] == [("2025-12", "si0040.php?__cjahr=2025&__cmonat=12&__canz=1&__cselect=0", "http://a"), ("2026-01", "si0040.php?__cjahr=2026&__cmonat=1&__canz=1&__cselect=0", "http://a")]
