"""Cached page and PDF sources.

A crawl is a table of wanted pages met by a cache table; only misses are fetched,
one partition for each host, with a pause between requests, and only successes are
appended to the cache.  The fetching function is an argument, so tests and archives
need no network.
"""

from __future__ import annotations

import time
from http.client import HTTPException
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_newlines, page_cache_key, pdf_cache_key

# Seconds between requests, timeouts of page and PDF, pages read of a PDF.
PAUSE, PAGE_TIMEOUT, PDF_TIMEOUT, PDF_PAGES = 1.2, 30, 60, 15

Fetch = Callable[[str], bytes]


def http_fetch(url: str, timeout: int = PAGE_TIMEOUT, agent: str = "agoralake") -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
        return answer.read()


def _fetched(fetch: Fetch, pause: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for url in batch["url"]:
                try:
                    bodies.append(fetch(url).decode("utf-8", "replace"))
                    time.sleep(pause)
                except (OSError, HTTPException, ValueError):  # one bad page or address ends no task
                    bodies.append(None)
            yield batch.assign(html=bodies)

    return run


def _fixed(got: DataFrame) -> DataFrame:
    """What was fetched, written to the shared checkpoint folder, so that nothing is fetched again."""
    spark = got.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")
    return got.checkpoint(eager=True)


def fetch_pages(wanted: DataFrame, cache: DataFrame, fetch: Fetch = http_fetch, pause: float = PAUSE, use_cache: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pages, new): wanted (base_url, path) with html from cache (key, html) or the network; new: rows to append to the cache.

    A page that cannot be fetched has html '' and is not cached; bytes that are no UTF-8 are replaced.
    Without use_cache everything is fetched anew, and new holds all of it.
    Misses are fetched once, into the shared checkpoint folder, and both results come from there.
    """
    keyed = wanted.withColumn("key", page_cache_key(F.col("base_url"), F.col("path")))
    hits = keyed.join(cache.select("key", "html").where(F.lit(use_cache)), "key", "left")
    misses = hits.where("html is null").select("key", F.concat("base_url", F.lit("/"), "path").alias("url"), F.regexp_extract("base_url", "^(?:https?://)?([^/]+)", 1).alias("host")).dropDuplicates(["key"])
    got = misses.repartition("host").mapInPandas(_fetched(fetch, pause), "key string, url string, host string, html string")
    got = _fixed(got)
    new = got.where("html is not null").select("key", "html")
    pages = hits.where("html is not null").select(*wanted.columns, "html").unionByName(hits.where("html is null").drop("html").join(new, "key", "left").select(*wanted.columns, F.coalesce("html", F.lit("")).alias("html")))
    return pages, new


def append_cache(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _pdf_texts(reader: Callable[[bytes, int], tuple[list[str], int]], most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, pages = [], []
            for content in batch["content"]:
                if content is None or not bytes(content).startswith(b"%PDF"):
                    texts.append("")
                    pages.append(0)
                    continue
                own, n = reader(bytes(content), most)
                texts.append("\n".join(own))
                pages.append(n)
            yield batch.drop(columns="content").assign(raw=texts, pages=pages)

    return run


def pdfplumber_reader(content: bytes, most: int) -> tuple[list[str], int]:
    """Texts of the first pages and the number of pages, by an optional library."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("PDF text needs the pdfplumber library") from e
    import io

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages[:most]], len(pdf.pages)


def pdf_text(files: DataFrame, reader: Callable[[bytes, int], tuple[list[str], int]] = pdfplumber_reader, most: int = PDF_PAGES) -> DataFrame:
    """(url, text, pages, note) of (url, content[, error]): ok, not loadable (null content; the error says why), no PDF, or a scan without text."""
    failed = F.coalesce(F.nullif("error", F.lit("")), F.lit("nicht ladbar")) if "error" in files.columns else F.lit("nicht ladbar")
    magic = F.substring("content", 1, 4) == F.lit(b"%PDF")
    state = files.select("url", "content", F.when(F.col("content").isNull(), failed).when(~magic, "kein PDF").otherwise("").alias("state"))
    read = state.mapInPandas(_pdf_texts(reader, most), "url string, state string, raw string, pages int")
    text = F.trim(collapse_newlines(F.col("raw")), F.lit(" \n\t\r"))
    note = F.when(F.col("state") != "", F.col("state")).when(text == "", "gescannt, keine Textebene — braeuchte OCR").otherwise("")
    return read.select("url", text.alias("text"), F.col("pages").cast("int").alias("pages"), note.alias("note"))


def _downloaded(fetch: Fetch, pause: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, errors = [], []
            for url in batch["url"]:
                try:
                    contents.append(fetch(url))
                    errors.append("")
                    time.sleep(pause)
                except (OSError, HTTPException, ValueError) as e:
                    contents.append(None)
                    errors.append(f"nicht ladbar: {e}")
            yield batch.assign(content=contents, error=errors)

    return run


def fetch_files(wanted: DataFrame, cache: DataFrame, fetch: Fetch = http_fetch, pause: float = PAUSE) -> tuple[DataFrame, DataFrame]:
    """(files, new): wanted (url) with content and error from cache (key, content) or the network; new: rows to append to the cache."""
    keyed = wanted.select("url").distinct().withColumn("key", pdf_cache_key(F.col("url")))
    hits = keyed.join(cache.select("key", "content"), "key", "left")
    host = F.regexp_extract("url", "^(?:https?://)?([^/]+)", 1)
    misses = hits.where("content is null").select("key", "url", host.alias("host"))
    got = _fixed(misses.repartition("host").mapInPandas(_downloaded(fetch, pause), "key string, url string, host string, content binary, error string"))
    files = hits.where("content is not null").select("url", "content", F.lit("").alias("error")).unionByName(got.select("url", "content", "error"))
    return files, got.where("content is not null").select("key", "content")
