"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response has a record id, a target URI, a date, HTTP headers and a payload.
``derivatives`` adds to each response a metadata record (title, language, links of
the page) and a conversion record (its plain text).  Both refer to the response by
WARC-Refers-To, keep its target URI and date, and name its payload digest; block
digests are SHA-1 in base 32.  Ids of derived records follow from the response's
id, so a second run yields the same records.  All of it is one pass without a
shuffle; texts with rare entities pass through Python's table of them.

``responses`` makes responses of a table of pages: the id follows from URL and
payload, so equal captures are equal records.  Columns with the date and the HTTP
headers of the capture are taken where the table has them; a null, or a table without
them, gives NO_DATE and the least headers of a page.  Null URLs and payloads count as
empty; a page without text still gets both records.  Line ends and control characters
in a URI are percent-encoded, in other values they are spaces, so no value can begin a
line of its own.

``write_records`` writes derived records as WARC 1.1 files, and ``read_records`` reads
such files back by their content lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unescaped

CRLF = "\r\n"
NO_DATE = "1970-01-01T00:00:00Z"


def digest(data: Column) -> Column:
    """sha1:<base 32> of text (UTF-8) or bytes."""
    hexed = F.sha1(data.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def urn(*parts: Column) -> Column:
    """<urn:uuid:...> of a hash of the parts (version 8: custom)."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 13, 3), F.lit("-b"), F.substring(h, 16, 3), F.lit("-"), F.substring(h, 19, 12), F.lit(">"))


#: What follows a tag's name; a quoted value after "=" may hold ">".
_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?[^>=]*+)*+"""


def without_markup(html: Column) -> Column:
    """Visible text with its entities: scripts, styles and comments go, block ends become line ends.

    A tag begins with a letter, "/", "!" or "?" right after "<"; any other "<" is text.  A comment, a script or the
    like that is never closed reaches to the end of the page."""
    x = F.regexp_replace(html, rf"(?is)<(?:!--.*?(?:--!?>|\z)|(script|style|noscript|template)\b{_ATTRIBUTES}>.*?(?:</\1\b[^>]*+>|\z))", " ")
    x = F.regexp_replace(x, rf"(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|title))\b{_ATTRIBUTES}>", "\n")
    return F.regexp_replace(x, rf"<(?:/?[A-Za-z]{_ATTRIBUTES}|[!?/][^>]*+)>", "")


def decoded(x: Column) -> Column:
    """Entities decoded, no-break spaces as spaces, white space squeezed."""
    x = F.replace(unescaped(x), F.lit("\u00a0"), F.lit(" "))
    # single spaces are as they should be, and most frequent
    x = F.regexp_replace(x, r"(?: [ \t\x0B\f\r]|[\t\x0B\f\r])[ \t\x0B\f\r]*+", " ")
    return F.trim(F.regexp_replace(x, r" \n[ \n]*+|\n[ \n]++", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """Visible text: markup goes, entities are decoded."""
    return decoded(without_markup(html))


def uri(x: Column) -> Column:
    """A URI in one line: white space and control characters percent-encoded."""
    for c in ("\r", "\n", "\t", " "):
        x = F.replace(x, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.regexp_replace(x, r"[\x00-\x1F\x7F]", "")


def one_line(x: Column) -> Column:
    """A field's value without line ends and control characters."""
    return F.regexp_replace(x, r"[\x00-\x1F\x7F]+", " ")


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str = "date", headers_col: str = "http_headers", date: str = NO_DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers, payload and payload_digest of each page."""
    url, html = F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    least = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"))
    when, headers = F.lit(date), least
    if date_col in pages.columns:
        own = F.col(date_col)
        own = F.date_format(own, "yyyy-MM-dd'T'HH:mm:ss'Z'") if dict(pages.dtypes)[date_col].startswith(("timestamp", "date")) else own.cast("string")
        when = F.coalesce(one_line(own), when)
    if headers_col in pages.columns:
        headers = F.coalesce(F.rtrim(F.col(headers_col).cast("string"), F.lit(CRLF)), headers)
    made = pages.select(F.col(id_col).cast("long").alias("page_id"), uri(url).alias("target_uri"), html.alias("payload"), when.alias("date"), headers.alias("http_headers"))
    made = made.withColumn("payload_digest", digest(F.col("payload")))
    return made.withColumn("record_id", urn(F.col("target_uri"), F.col("payload_digest")))


def _record(kind: str, content_type: str, block: str) -> Column:
    return F.struct(
        F.lit(kind).alias("record_type"),
        urn(F.lit(kind), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("target_uri").alias("target_uri"),
        F.col("date").alias("date"),
        F.col("payload_digest").alias("source_digest"),
        F.lit(content_type).alias("content_type"),
        F.octet_length(block).cast("long").alias("content_length"),
        digest(F.col(block)).alias("block_digest"),
        F.col(block).alias("block"),
    )


def derivatives(found: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, the fields of the record and its block."""
    html = F.col("payload")
    # title and language stand in a page's head
    title = F.trim(F.regexp_replace(decoded(F.col("title")), r"\s+", " "))
    language = F.regexp_extract(html, r"(?i)<html[^>]*?\slang=[\"']?([A-Za-z-]+)", 1)
    links = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"'>]*)"), F.lit(1)))
    lines = F.concat(
        F.array(F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("language: "), F.col("language")), F.concat(F.lit("source-headers: "), one_line(F.regexp_replace("http_headers", r"\r?\n", "; ")))),
        F.transform("links", lambda x: F.concat(F.lit("outlink: "), uri(x))),
    )
    fields = ("page_id", "record_id", "target_uri", "date", "payload_digest", "http_headers")
    bare = found.select(*fields, without_markup(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)).alias("title"), language.alias("language"), links.alias("links"), without_markup(html).alias("text"))
    parsed = bare.withColumns({"title": title, "text": decoded(F.col("text"))})
    parsed = parsed.select(*fields[:-1], F.array_join(lines, CRLF).alias("fields"), "text")
    both = F.array(_record("metadata", "application/warc-fields", "fields"), _record("conversion", "text/plain; charset=utf-8", "text"))
    return parsed.select("page_id", F.explode(both).alias("r")).select("page_id", "r.*")


def record_text() -> Column:
    """A derived record as it stands in a WARC 1.1 file."""
    head = [
        F.lit("WARC/1.1"),
        *[F.concat(F.lit(f"{name}: "), F.col(column).cast("string")) for name, column in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))],
    ]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2))


def write_records(derived: DataFrame, path: str, *, file_bytes: int = 64 << 20) -> None:
    """Derived records as WARC files below path, dealt evenly to so many that each holds about file_bytes at most, or a
    longer record; a reader takes a file as one value, so it must stay well below 2 GB."""
    whole = record_text()  # its last byte is the writer's line end
    size = derived.agg(F.sum("content_length")).first()[0] or 0
    rows = derived.select(F.substring(whole, F.lit(1), F.length(whole) - 1).alias("value"))
    # half full on average: records differ in length, and have headers
    rows.repartition(-(-2 * size // file_bytes) or 1).write.option("lineSep", "\n").text(path)


#: Columns of read_records by their header.
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "block_digest": "WARC-Block-Digest", "source_digest": "WARC-Source-Payload-Digest", "content_type": "Content-Type"}


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : max(end, at)].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            for headers, block in parsed(content.as_py()):
                yield pa.RecordBatch.from_arrays([*[pa.array([headers.get(h)], pa.string()) for h in _HEADERS.values()], pa.array([block.decode()], pa.string())], names=[*_HEADERS, "block"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: record_type, record_id, refers_to, target_uri, date, digests, content_type and block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse, ", ".join(f"{c} string" for c in [*_HEADERS, "block"]))
