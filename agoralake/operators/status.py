"""A topic's status from its chain of planned stages.  Roles are plans: no status says that a decision was taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import known

# Statuses in their official order.
STATUSES = ("Entscheidung geplant", "Wird noch beraten", "Entscheidung angesetzt", "Bekanntgabe", "Ohne Vorlage")
NO_PROPOSAL = "Ohne Vorlage"


def latest(stages: Column) -> Column:
    """The stage with the greatest date, the first one within ties; null if there is none."""
    none = F.lit(None).cast("struct<date_iso:string,date_disp:string,role:string>")
    slim = F.transform(stages, lambda s: F.struct(s["date_iso"].alias("date_iso"), s["date_disp"].alias("date_disp"), s["role"].alias("role")))
    return F.aggregate(slim, none, lambda best, s: F.when(best.isNull() | (s["date_iso"] > best["date_iso"]), s).otherwise(best))


def derived(proposal: Column, stages: Column, as_of: str | Column) -> Column:
    """struct<status, status_date>; the first rule that fits counts."""
    today = F.lit(as_of) if isinstance(as_of, str) else as_of
    slim = F.transform(stages, lambda s: F.struct(s["date_iso"].alias("date_iso"), s["date_disp"].alias("date_disp"), s["role"].alias("role")))
    none = F.lit(None).cast("struct<date_iso:string,date_disp:string,role:string>")
    words = {"decision": "Entscheidung", "before": "Vorberatung", "notice": "Bekanntgabe", "last": ""}

    def step(best: Column, s: Column) -> Column:
        """The latest stage of each class so far, the first one within ties."""
        later = lambda own, word: F.when(F.contains(s["role"], F.lit(word)) & (own.isNull() | (s["date_iso"] > own["date_iso"])), s).otherwise(own)
        return F.struct(*[later(best[name], word).alias(name) for name, word in words.items()])

    out = lambda status, date: F.struct(status.alias("status"), date.alias("status_date"))
    unplanned = out(F.lit(NO_PROPOSAL), F.lit(""))

    def told(best: Column) -> Column:
        planned = F.when(best["decision"]["date_iso"] <= today, "Entscheidung angesetzt").otherwise("Entscheidung geplant")
        return (
            F.when(best["decision"].isNotNull(), out(planned, best["decision"]["date_disp"]))
            .when(best["before"].isNotNull(), out(F.lit("Wird noch beraten"), best["before"]["date_disp"]))
            .when(best["notice"].isNotNull(), out(F.lit("Bekanntgabe"), best["notice"]["date_disp"]))
            .when(best["last"].isNotNull(), out(best["last"]["role"], best["last"]["date_disp"]))
            .otherwise(unplanned)
        )

    # one pass over the stages
    found = F.aggregate(slim, F.struct(*[none.alias(name) for name in words]), step, told)
    return F.when(known(proposal) == "", unplanned).otherwise(F.coalesce(found, unplanned))
