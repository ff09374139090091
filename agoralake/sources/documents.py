"""Raw corpus and feed under their files' own field names: one document, or a folder of lines of any size.

A folder holds ``head`` (one JSON text: everything but the rows) and ``rows`` (a JSON text a
line, with the row's place in ``_ord``), so that many tasks write and read it.  A document
holds both in one JSON text and is for small corpora and feeds: ``document`` refuses more than
``most_bytes``.  Readers take either form and give the columns of this library.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import known
from . import records

Names = tuple[tuple[str, str], ...]

# Field names of the files, and the columns of this library that they hold, in the files' order.
DOCUMENT: Names = (("titel", "title"), ("url", "url"))
STAGE: Names = (("datum", "date_iso"), ("datum_anzeige", "date_disp"), ("gremium", "body"), ("top_nr", "nr"), ("oeffentlich", "is_public"), ("rolle", "role"), ("sitzung_url", "session_url"))
APPEARANCE: Names = (("datum", "date_iso"), ("datum_anzeige", "date_disp"), ("gremium", "body"), ("top_nr", "nr"), ("sitzung_url", "session_url"))
ENTRY: Names = (
    ("ref", "ref"), ("thema", "topic"), ("auftritte", "appearances"), ("klartext_titel", "title_plain"), ("klartext", "text_plain"), ("klartext_titel_leicht", "title_easy"), ("klartext_leicht", "text_easy"),
    ("lebenslage", "life"), ("bezirk", "district"), ("anlass", "occasion"), ("ort", "place"), ("entwurf", "is_draft"), ("stand", "status"), ("stand_datum", "status_date"), ("niederschrift_url", "minutes_url"),
    ("quelle", "source"), ("amtlicher_titel", "official_title"), ("top_nr", "nr"), ("vorlage", "proposal"), ("vorlage_url", "proposal_url"), ("antragsteller", "applicant"), ("gremium", "body"),
    ("sitzung_kennung", "code"), ("datum", "date_iso"), ("datum_anzeige", "date_disp"), ("sitzung_url", "session_url"), ("dokumente", "documents"), ("beratungsweg", "stages"),
)
STATISTICS: Names = (("sitzungen_ausgelesen", "sessions"), ("tops_ausgelesen", "items"), ("tops_verfahren", "routine"), ("tops_kuratiert", "curated"), ("entwuerfe", "drafts"), ("leichte_sprache", "easy"), ("je_quelle", "per_source"), ("stand", "status"))
AXES: Names = (("lebenslage", "life"), ("bezirk", "district"), ("anlass", "occasion"), ("stand", "statuses"))

_NESTED = {"appearances": APPEARANCE, "documents": DOCUMENT, "stages": STAGE}
_LABELS, _FLAGS = ("life", "district", "occasion", "place"), ("is_draft", "is_public")


def _type(name: str) -> str:
    if name in _NESTED:
        return "ARRAY<STRUCT<" + ", ".join(f"{theirs}: {_type(ours)}" for theirs, ours in _NESTED[name]) + ">>"
    return "ARRAY<STRING>" if name in _LABELS else "BOOLEAN" if name in _FLAGS else "STRING"


_FIELDS = ", ".join(f"{theirs}: {_type(ours)}" for theirs, ours in ENTRY)
_SOURCES = "MAP<STRING, STRUCT<name: STRING, software: STRING, basis_url: STRING, anzahl_sitzungen: BIGINT, anzahl_tops: BIGINT>>"
_COUNTS = ", ".join(f"{theirs}: {'MAP<STRING, BIGINT>' if ours in ('per_source', 'status') else 'BIGINT'}" for theirs, ours in STATISTICS)
HEAD_SCHEMA = f"stadt STRING, quellen {_SOURCES}, hinweis STRING, daten_abgerufen_am STRING, feed_gebaut_am STRING, zeitraum STRUCT<von: STRING, bis: STRING>, statistik STRUCT<{_COUNTS}>, achsen STRUCT<" + ", ".join(f"{t}: ARRAY<STRING>" for t, _ in AXES) + ">"
ENTRY_SCHEMA = ", ".join(f"{theirs} {_type(ours)}" for theirs, ours in ENTRY)
FEED_SCHEMA = f"{HEAD_SCHEMA}, eintraege ARRAY<STRUCT<{_FIELDS}>>"


def _each(values: Column, names: Names, theirs: bool) -> Column:
    return F.transform(values, lambda v: _renamed(v, names, theirs))


def _renamed(value: Column, names: Names, theirs: bool) -> Column:
    """A struct's fields in order, from ours to theirs or back; missing texts are '', lists [], flags false."""
    fields = []
    for their, our in names:
        field = value[our if theirs else their]
        if our in _NESTED:
            empty = F.array().cast(_type(our)) if not theirs else None
            field = _each(field if theirs else F.coalesce(field, empty), _NESTED[our], theirs)
        elif not theirs:
            field = F.coalesce(field, F.array().cast("array<string>") if our in _LABELS else F.lit(False) if our in _FLAGS else F.lit(""))
        fields.append(field.alias(their if theirs else our))
    return F.struct(*fields)


def own_entries(feed: DataFrame) -> DataFrame:
    """(_ord, entry): a feed's entries under their own names; _ord is (blank date last, date descending, topic_ord) as one text."""
    place = F.concat(F.lpad((F.lit(99999999) - F.coalesce(F.regexp_replace("date_iso", "-", "").try_cast("long"), F.lit(0))).cast("string"), 8, "0"), F.lpad(F.col("topic_ord").cast("string"), 20, "0"))
    return feed.select(place.alias("_ord"), _renamed(F.struct(*[c for _, c in ENTRY]), ENTRY, True).alias("entry"))


def own_head(row: DataFrame, raw_head: DataFrame, city: str, built: str) -> DataFrame:
    """The feed's head: that of the raw corpus, and the row (statistics, axes) of feed.full_header, in one row."""
    counts = F.struct(*[F.col("statistics")[ours].alias(theirs) for theirs, ours in STATISTICS])
    axes = F.struct(*[F.col("axes")[ours].alias(theirs) for theirs, ours in AXES])
    made = row.select(counts.alias("statistik"), axes.alias("achsen"))
    head = raw_head.select(F.lit(city).alias("stadt"), "quellen", known(F.col("hinweis")).alias("hinweis"), F.col("abgerufen_am").alias("daten_abgerufen_am"), F.lit(built).alias("feed_gebaut_am"), "zeitraum")
    return head.join(made)  # two rows of one row each


def raw_head(sessions: DataFrame, registry: DataFrame, note: str, fetched: str, first: str, last: str) -> DataFrame:
    """The raw corpus's head in one row: sources with their counts, note, day, period, totals.  registry: (source, name, base_url, ord) of the chosen sources."""
    routine = F.size(F.filter("items", lambda t: t["is_routine"]))
    counted = sessions.select("source", F.lit(1).alias("sessions"), F.size("items").alias("items"), routine.alias("routine"))
    zero = registry.select("source", *[F.lit(0).alias(c) for c in ("sessions", "items", "routine")])
    per = counted.unionByName(zero).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("sessions", "items", "routine")])
    named = per.join(registry.select("source", "name", "base_url", F.col("ord").alias("_place")), "source")
    one = F.struct(F.col("name"), F.lit("").alias("software"), F.col("base_url").alias("basis_url"), F.col("sessions").alias("anzahl_sitzungen"), F.col("items").alias("anzahl_tops"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", "source", one.alias("one")))), lambda x: F.struct(x["source"].alias("key"), x["one"].alias("value")))
    row = named.agg(F.map_from_entries(listed).alias("quellen"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "items", "routine")])
    return row.select("quellen", F.lit(note).alias("hinweis"), F.lit(fetched).alias("abgerufen_am"), F.struct(F.lit(first).alias("von"), F.lit(last).alias("bis")).alias("zeitraum"), F.col("sessions").alias("anzahl_sitzungen"), F.col("items").alias("anzahl_tops"), F.col("routine").alias("anzahl_verfahren"))


def own_sessions(sessions: DataFrame) -> DataFrame:
    """(_ord, entry): sessions under their own names, in the order of session_ord."""
    raw = records.raw_sessions(sessions, keep=("session_ord",))
    return raw.select(F.lpad(F.col("session_ord").cast("string"), 20, "0").alias("_ord"), F.struct(*[c for c in raw.columns if c != "session_ord"]).alias("entry"))


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def write_rows(rows: DataFrame, path: str) -> dict[str, int]:
    """rows (_ord, entry) below path, in order over all files; how many were written, and their bytes, are observed on the way."""
    seen = Observation()
    lines = rows.select("_ord", _json(F.struct(F.col("_ord"), F.col("entry.*"))).alias("value"))
    lines = lines.repartitionByRange("_ord").sortWithinPartitions("_ord").observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))
    lines.select("value").write.text(f"{path}/rows")
    return dict(seen.get)


def write_head(head: DataFrame, path: str) -> None:
    head.select(_json(F.struct("*")).alias("value")).write.text(f"{path}/head")


def document(head: DataFrame, rows: DataFrame, name: str, most_bytes: int = 1 << 28) -> DataFrame:
    """One row, one JSON text: head, and under name all rows in order.  More than most_bytes are refused: write_rows has any size."""
    size = rows.select(F.sum(F.octet_length(_json(F.col("entry")))).alias("n")).first()["n"] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes are no single document; use write_rows and write_head")
    listed = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "entry"))), lambda r: r["entry"]).alias(name))
    return head.join(listed).select(_json(F.struct("*")).alias("value"))


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows of a folder; None where path is none."""
    try:
        return spark.read.schema(f"_ord STRING, {schema}").json(f"{path}/rows")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed's entries with feed_ord (ascending in feed order) and the columns of operators.feed; MissingInput where none was built."""
    lines = _lines(spark, path, ENTRY_SCHEMA)
    if lines is None:
        whole = records.read_json(spark, path, FEED_SCHEMA)
        lines = whole.select(F.posexplode("eintraege").alias("_ord", "e")).select(F.lpad(F.col("_ord").cast("string"), 20, "0").alias("_ord"), "e.*")
    return lines.select(F.col("_ord").alias("feed_ord"), _renamed(F.struct(*[c for c in lines.columns if c != "_ord"]), ENTRY, False).alias("e")).select("feed_ord", "e.*")


def read_feed_head(spark: SparkSession, path: str) -> DataFrame:
    """A feed's head in one row, under its own names."""
    if _lines(spark, path, ENTRY_SCHEMA) is None:
        return records.read_json(spark, path, HEAD_SCHEMA)
    return records.read_json(spark, f"{path}/head", HEAD_SCHEMA)


def read_raw_head(spark: SparkSession, path: str) -> DataFrame:
    """A raw corpus's head in one row, under its own names."""
    where = path if _lines(spark, path, records.SESSION_SCHEMA) is None else f"{path}/head"
    return records.read_json(spark, where, records.RAW_SCHEMA).drop("sitzungen")


def curation_document(curation: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row, one JSON text: a curation under its own names, entries in the order of cur_ord; empty easy texts are left out."""
    easy = lambda c: F.nullif(F.col(c), F.lit(""))
    entry = F.struct(F.col("title_plain").alias("klartext_titel"), F.col("text_plain").alias("klartext"), easy("title_easy").alias("klartext_titel_leicht"), easy("text_easy").alias("klartext_leicht"), F.col("life").alias("lebenslage"), F.col("district").alias("bezirk"), F.col("place").alias("ort"), F.col("occasion").alias("anlass"), F.col("is_draft").alias("entwurf"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cur_ord", "ref", entry.alias("entry")))), lambda e: F.struct(e["ref"].alias("key"), e["entry"].alias("value")))
    values = lambda axis: F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct("ord", "value")))), lambda v: v["value"])
    axes = vocabulary.agg(F.struct(*[values(ours).alias(theirs) for ours, theirs in records.AXES.items()]).alias("_achsen"))
    return axes.join(curation.agg(F.map_from_entries(listed).alias("eintraege"))).select(F.to_json(F.struct("*")).alias("value"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row per session of a raw corpus in either form: of a folder many tasks read parts, a document is one row of one task."""
    lines = _lines(spark, path, records.SESSION_SCHEMA)
    if lines is None:
        return records.sessions_of(records.read_json(spark, path, records.RAW_SCHEMA))
    return records.session_columns(lines.select(F.col("_ord").cast("long").alias("session_ord"), F.struct(*[c for c in lines.columns if c != "_ord"]).alias("s")))
