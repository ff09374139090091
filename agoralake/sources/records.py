"""Schemas and readers of raw corpus, curation and feed.

Record files keep their own (German) field names; the frames use the names of this
library.  Order in a file carries meaning (ties, positions), so every frame has an
ordinal: session_ord, item_ord, cur_ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import known

DOCUMENTS = "array<struct<title:string,url:string>>"
STAGES = "array<struct<date_iso:string,date_disp:string,body:string,nr:string,is_public:boolean,role:string,session_url:string>>"

_DOC = "ARRAY<STRUCT<titel: STRING, url: STRING>>"
_STAGE = "ARRAY<STRUCT<datum: STRING, datum_anzeige: STRING, gremium: STRING, top_nr: STRING, oeffentlich: BOOLEAN, rolle: STRING, sitzung_url: STRING>>"
_ITEM = f"ARRAY<STRUCT<nr: STRING, titel: STRING, zusatz: STRING, antragsteller: STRING, nachtrag: STRING, oeffentlich: BOOLEAN, verfahren: BOOLEAN, vorlage: STRING, vorlage_url: STRING, dokumente: {_DOC}, beratungen: {_STAGE}>>"
SESSION_SCHEMA = f"id STRING, kennung STRING, gremium STRING, raum STRING, datum STRING, datum_anzeige STRING, zeit STRING, url STRING, dokumente {_DOC}, tops {_ITEM}, quelle STRING"
_SESSION = f"ARRAY<STRUCT<id: STRING, kennung: STRING, gremium: STRING, raum: STRING, datum: STRING, datum_anzeige: STRING, zeit: STRING, url: STRING, dokumente: {_DOC}, tops: {_ITEM}, quelle: STRING>>"
RAW_SCHEMA = f"quellen MAP<STRING, STRUCT<name: STRING, software: STRING, basis_url: STRING, anzahl_sitzungen: INT, anzahl_tops: INT>>, hinweis STRING, abgerufen_am STRING, zeitraum STRUCT<von: STRING, bis: STRING>, anzahl_sitzungen INT, anzahl_tops INT, anzahl_verfahren INT, sitzungen {_SESSION}"
_ENTRY = "STRUCT<klartext_titel: STRING, klartext: STRING, klartext_titel_leicht: STRING, klartext_leicht: STRING, lebenslage: ARRAY<STRING>, bezirk: ARRAY<STRING>, ort: ARRAY<STRING>, anlass: ARRAY<STRING>, entwurf: BOOLEAN>"
CURATION_SCHEMA = f"_achsen STRUCT<lebenslage: ARRAY<STRING>, bezirk: ARRAY<STRING>, anlass: ARRAY<STRING>>, eintraege MAP<STRING, {_ENTRY}>"

AXES = {"life": "lebenslage", "district": "bezirk", "occasion": "anlass"}


class MissingInput(FileNotFoundError):
    """An input that another program has to write first."""


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document as one row; MissingInput where there is no file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(path) from e
        raise


def _documents(c):
    return F.transform(F.coalesce(c, F.array().cast(DOCUMENTS.replace("title", "titel"))), lambda d: F.struct(known(d["titel"]).alias("title"), known(d["url"]).alias("url")))


def _stages(c):
    return F.transform(
        F.coalesce(c, F.array().cast(_STAGE)),
        lambda s: F.struct(known(s["datum"]).alias("date_iso"), known(s["datum_anzeige"]).alias("date_disp"), known(s["gremium"]).alias("body"), known(s["top_nr"]).alias("nr"), F.coalesce(s["oeffentlich"], F.lit(False)).alias("is_public"), known(s["rolle"]).alias("role"), known(s["sitzung_url"]).alias("session_url")),
    )


def sessions_of(raw: DataFrame) -> DataFrame:
    """One row per session of the raw corpus, its items as an array."""
    return session_columns(raw.select(F.posexplode("sitzungen").alias("session_ord", "s")))


def session_columns(each: DataFrame) -> DataFrame:
    """The columns of this library for (session_ord, s), s a session under its own names."""
    return each.select(
        F.coalesce("s.quelle", F.lit("stadt")).alias("source"),
        F.col("s.id").alias("session_id"),
        known(F.col("s.kennung")).alias("code"),
        known(F.col("s.gremium")).alias("body"),
        known(F.col("s.raum")).alias("room"),
        known(F.col("s.datum")).alias("date_iso"),
        known(F.col("s.datum_anzeige")).alias("date_disp"),
        known(F.col("s.zeit")).alias("time"),
        known(F.col("s.url")).alias("session_url"),
        _documents(F.col("s.dokumente")).alias("session_documents"),
        F.col("s.tops").alias("items"),
        F.col("session_ord").cast("long").alias("session_ord"),
    )


def items_of(sessions: DataFrame) -> DataFrame:
    """One row per agenda item with the fields of its session, ref and topic."""
    from ..operators.topics import with_keys

    each = sessions.select("*", F.posexplode("items").alias("item_ord", "t")).drop("items")
    return with_keys(
        each.select(
            *[c for c in sessions.columns if c != "items"],
            F.col("item_ord").cast("long").alias("item_ord"),
            known(F.col("t.nr")).alias("nr"),
            known(F.col("t.titel")).alias("title"),
            known(F.col("t.zusatz")).alias("suffix"),
            known(F.col("t.antragsteller")).alias("applicant"),
            known(F.col("t.nachtrag")).alias("addendum"),
            F.coalesce("t.oeffentlich", F.lit(False)).alias("is_public"),
            F.coalesce("t.verfahren", F.lit(False)).alias("is_routine"),
            known(F.col("t.vorlage")).alias("proposal"),
            known(F.col("t.vorlage_url")).alias("proposal_url"),
            _documents(F.col("t.dokumente")).alias("documents"),
            _stages(F.col("t.beratungen")).alias("stages"),
        )
    )


def curation_of(curation: DataFrame) -> DataFrame:
    """One row per curated ref in file order; the two required texts may be empty but not missing."""
    each = curation.select(F.posexplode(F.map_entries("eintraege")).alias("cur_ord", "e"))
    labels = lambda name: F.coalesce(F.col(f"e.value.{name}"), F.array().cast("array<string>"))
    return each.where("e.value.klartext_titel is not null and e.value.klartext is not null").select(
        F.col("e.key").alias("ref"),
        F.col("e.value.klartext_titel").alias("title_plain"),
        F.col("e.value.klartext").alias("text_plain"),
        known(F.col("e.value.klartext_titel_leicht")).alias("title_easy"),
        known(F.col("e.value.klartext_leicht")).alias("text_easy"),
        labels("lebenslage").alias("life"),
        labels("bezirk").alias("district"),
        labels("ort").alias("place"),
        labels("anlass").alias("occasion"),
        F.coalesce("e.value.entwurf", F.lit(False)).alias("is_draft"),
        F.col("cur_ord").cast("long").alias("cur_ord"),
    )


def vocabulary_of(curation: DataFrame) -> DataFrame:
    """(axis, value, ord): the values each axis allows, in their official order."""
    parts = [curation.select(F.lit(ours).alias("axis"), F.posexplode(F.col(f"_achsen.{theirs}")).alias("ord", "value")) for ours, theirs in AXES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("axis", "value", "ord")


def raw_sessions(sessions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sessions (with items, their fields as in this library) under the raw corpus's own field names, one row per session; columns to keep come last."""
    docs = lambda c: F.transform(c, lambda d: F.struct(d["title"].alias("titel"), d["url"].alias("url")))
    stages = lambda c: F.transform(c, lambda s: F.struct(s["date_iso"].alias("datum"), s["date_disp"].alias("datum_anzeige"), s["body"].alias("gremium"), s["nr"].alias("top_nr"), s["is_public"].alias("oeffentlich"), s["role"].alias("rolle"), s["session_url"].alias("sitzung_url")))
    item = lambda t: F.struct(
        t["nr"].alias("nr"), t["title"].alias("titel"), t["suffix"].alias("zusatz"), t["applicant"].alias("antragsteller"), t["addendum"].alias("nachtrag"), t["is_public"].alias("oeffentlich"),
        t["is_routine"].alias("verfahren"), t["proposal"].alias("vorlage"), t["proposal_url"].alias("vorlage_url"), docs(t["documents"]).alias("dokumente"), stages(t["stages"]).alias("beratungen"),
    )
    return sessions.select(
        F.col("session_id").alias("id"), F.col("code").alias("kennung"), F.col("body").alias("gremium"), F.col("room").alias("raum"), F.col("date_iso").alias("datum"), F.col("date_disp").alias("datum_anzeige"),
        F.col("time").alias("zeit"), F.col("session_url").alias("url"), docs("session_documents").alias("dokumente"), F.transform("items", item).alias("tops"), F.col("source").alias("quelle"), *keep,
    )


def source_registry(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """(source, name, base_url, ord) of a small registry {source: (name, base URL)}."""
    rows = [(k, *v, i) for i, (k, v) in enumerate(sources.items())]
    return spark.createDataFrame(rows, "source string, name string, base_url string, ord int")


def chosen_sources(df: DataFrame, source: str) -> DataFrame:
    """Rows of one source, or of both ('beide')."""
    return df if source == "beide" else df.where(F.coalesce("source", F.lit("stadt")) == source)


def months(spark: SparkSession, first: str | None, last: str | None, as_of: str) -> DataFrame:
    """(year, month) from first to last ('YYYY-MM', both included); two months before as_of to as_of by default; none if first is later."""
    first_day = F.to_date(F.lit(f"{first}-01")) if first else F.add_months(F.trunc(F.to_date(F.lit(as_of)), "MM"), -2)
    last_day = F.to_date(F.lit(f"{last}-01")) if last else F.trunc(F.to_date(F.lit(as_of)), "MM")
    days = F.when(first_day <= last_day, F.sequence(first_day, last_day, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(days).alias("day")).select(F.year("day").alias("year"), F.month("day").alias("month"))
