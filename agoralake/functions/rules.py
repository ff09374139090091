"""Rule tables and what they decide: tables of many patterns in one pass (see keywords), few patterns as one literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keywords import any_found, labels_found
from .text import known

# Keyword patterns and the labels they give, in order.
LIFE_SITUATIONS = (
    (r"kita|kinderbetreuung|kindertages|krippe|grundschul|\bschul|schulweg|musikschule|eltern|ganztag|spielplatz|spielger(ä|ae)t|kinder", "Eltern & Kinder"),
    (r"jugend|jupa|jugendparlament|jugendarbeit|stadtjugendring|skate|bolzplatz|basketball", "Jugend"),
    (r"senior|pflegeheim|altenpflege|altenhilfe|rollator|generationen|altenheim|ruhestand", "Senior:innen"),
    (r"gesundheit|\bpflege\b|pflegebericht|klinik|krankenhaus|(ä|ae)rzt|selbsthilfe|sucht|psychiatr|psychosozial|hospiz|impf|seuchen|barrierefrei|behinder|inklusion|teilhabe", "Gesundheit & Pflege"),
    (r"arbeitsmarkt|arbeitsplat|arbeitslos|besch(ä|ae)ftig|stellenabbau|qualifizier|umschul|jobcenter|fachkr(ä|ae)fte|ausbildungsplat|tvo(ö|oe)d|tarifbesch(ä|ae)ftig|arbeitszeit|stellenplan|personalamt", "Arbeit & Beruf"),
    (r"sozialleistung|zuschuss f(ü|ue)r|f(ö|oe)rderrichtlinie|armut|wohngeld|grundsicherung|\btafel\b|obdachlos|wohnungslos|sozialpass|hilfe zur pflege|bildungspaket", "Geld & Soziales"),
    (r"asyl|gefl(ü|ue)chtet|fl(ü|ue)chtling|migration|integration|zuwander|ukrain|sprachkurs", "Zuwanderung & Integration"),
    (r"verein|ehrenamt|f(ö|oe)rderverein|freiwillige|b(ü|ue)rgerschaftliches|brauchtum|sch(ü|ue)tzen|feuerwehrverein", "Ehrenamt & Vereine"),
    (r"wohn|\bmiet|bebauungsplan|fl(ä|ae)chennutzung|grundst(ü|ue)ck|kanalsanierung|kanalnetz|abwasser|abfall|m(ü|ue)ll|geb(ü|ue)hrensatzung|zweitwohnung|nachbarschaft", "Wohnen & Miete"),
    (r"gewerbe|gastro|au(ß|ss)enbestuhlung|christkindlmarkt|wochenmarkt|marktgeb|standgeb|volksfest|b(ü|ue)rgerfest|laden|wirtschaft|einzelhandel", "Gewerbe & Gastro"),
    (r"verkehr|radweg|radverkehr|fahrrad|radl|\bbus\b|bush(ä|ae)us|(ö|oe)pnv|stadtbus|parkplatz|parken|parkbucht|parkhaus|parkgeb|tempo|30-?er|stra(ß|ss)e|str\.|gehweg|fu(ß|ss)weg|br(ü|ue)cke|ampel|fu(ß|ss)g(ä|ae)nger|verkehrsz|zebrastreifen|taktzeit|fahrplan|geschwindigkeit|\bb ?16\b|ausbau der b", "Unterwegs"),
    (r"sport|\bbad\b|hallenbad|therme|freibad|\bsee\b|baggersee|weiher|\bpark\b|piuspark|gr(ü|ue)nanlage|freizeit|kultur|bibliothek|theater|\bfest\b|schachtisch|spielplatz|cricket|bolzplatz|spielfeld", "Freizeit & Sport"),
    (r"studier|hochschule|\bthi\b|universit", "Studierende"),
)
OCCASIONS = (
    (r"geb(ü|ue)hr|tarif|preis|entgelt|beitrag|steuer|kosten|haushalt|\bbhh\b", "Gebühren & Preise"),
    (r"kita|kindertages|kinderbetreuung|ganztag|krippe", "Kinderbetreuung"),
    (r"schulbau|schulcampus|schulentwicklung|schulraum|neubau der .*schule", "Schulbau"),
    (r"bebauungsplan|fl(ä|ae)chennutzungsplan|gr(ü|ue)nordnungsplan|satzungsbeschluss|bauleitplan", "Bauleitplanung"),
    (r"verkehr|radweg|fahrplan|(ö|oe)pnv|tempo|30-?er|parken|parkbucht|verkehrlich|taktzeit|ampel|zebrastreifen|fahrradstra(ß|ss)e", "Verkehrsplanung"),
    (r"sicherheit|gutachten|gefahr|gef(ä|ae)hrlich|(ü|ue)berschwemmung|hochwasser|brand|vandalismus|besch(ä|ae)digung|beleuchtung", "Sicherheit"),
    (r"satzung|verordnung|allgemeinverf(ü|ue)gung|richtlinie|gesch(ä|ae)ftsordnung", "Satzung & Regeln"),
    (r"konzept|planung|bedarfsplan|strategie|bericht|analyse|befragung", "Konzept & Planung"),
    (r"sanierung|baustelle|umbau|instandsetzung|erneuerung", "Baustelle"),
    (r"klima|energie|solar|photovolt|windkraft|w(ä|ae)rmeplan|w(ä|ae)rmenetz|nachhaltig|umweltschutz|luftrein|l(ä|ae)rm|artenschutz|biodivers|starkregen|hitze", "Klima & Umwelt"),
    (r"kultur|museum|theater|bibliothek|stadtb(ü|ue)cherei|musikschule|volkshochschule|\bvhs\b|denkmal|archiv|konzert|ausstellung|stadttheater|kunst", "Kultur & Bildung"),
    (r"baum|b(ä|ae)ume|baumf(ä|ae)ll|baumpflanz|gr(ü|ue)n|hecke|wiese|m(ü|ue)lleimer|verm(ü|ue)ll|sauberkeit|hundekot|papierkorb|trinkbrunnen|sitzbank|bank\b|pflege\b|unkraut|abpflaster|entsiegel", "Grün & Sauberkeit"),
)

# Titles of items that are mere routine of a session.
ROUTINE = (
    r"^Er(ö|oe)ffnung",
    r"^Begr(ü|ue)ßung",
    r"Feststellung der Beschlussf(ä|ae)higkeit",
    r"Genehmigung des letzten Sitzungsprotokolls",
    r"Genehmigung der Niederschrift",
    r"(Best(ä|ae)tigung|Erg(ä|ae)nzung).{0,30}letzten Protokolls",
    r"^Wahlen?\b.{0,40}Sprecher",
    r"Beschluss der Tagesordnung",
    r"^Verschiedenes",
    r"^W(ü|ue)nsche",
    r"^Anfragen$",
    r"Offene Anfragen und Antr(ä|ae)ge",
    r"Weitere Anliegen der B(ü|ue)rgerschaft",
    r"^Antr(ä|ae)ge an die Verwaltung",
    r"^Anfragen aus dem Stadtteil$",
    r"Informationen zu den Bezirksaussch(ü|ue)ssen",
    r"^Allgemeine Aufgaben$",
    r"^Rechtliche Grundlagen$",
    r"^Ratsinformationssystem$",
    r"^Abl(ä|ae)ufe bei Antr(ä|ae)gen$",
    r"^Informationen und Unterrichtung",
    r"^Mit+eilungen\b.{0,60}(Stadt|Verwaltung)",
    r"^Stellungnahmen der (Stadt|Verwaltung|Stadtverwaltung)\s*$",
    r"^(Neu-? ?und )?Umbesetzung(en)? in den (Aussch|Gremien)",
    r"^Neu- und Umbesetzungen",
    r"^B(ü|ue)rgeranliegen und Antr(ä|ae)ge",
    r"^Antr(ä|ae)ge der (B(ü|ue)rger|BZA|Bezirksaussch)",
    r"^B(ü|ue)rgerantr(ä|ae)ge$",
    r"^Umgesetzte Ma(ß|ss)nahmen$",
    r"Feststellung der ordnungsgem(ä|ae)(ß|ss)en Ladung",
    r"^Genehmigung des Protokolls",
    r"^Fragestunde",
    r"^Dringlichkeitsantr(ä|ae)ge$",
    r"^Genehmigung von Sitzungsniederschriften",
    r"^Bekanntgaben?$",
    r"^Sonstiges$",
    r"^Niederschrift(en)?$",
    r"^Antr(ä|ae)ge$",
    r"^Protokolle der BZA-Sitzungen",
    r"^Nicht (ö|oe)ffentliche Beratung",
    r"^Termin n(ä|ae)chste",
    r"^Weitere Positionen im Bezirksausschuss",
    r"^Behindertenbeauftragt",
    r"^(Bestellung|Wahl)\s+.{0,40}beauftragte",
    r"^[\w\s/,-]{0,45}beauftragte[rn]?( des \w+)?$",
    r"\(je \d+ Person",
)

# Single tables.
HOLDING_BODY = r"Aufsichtsrat|Verwaltungsrat|\bAöR\b|GmbH|Zweckverband|Verbandsversammlung|Beirat|Kommission|Gesellschafterversammlung"
PLACE_WORD = r"stra(ß|ss)e|str\.|platz|weg\b|park|see\b|allee|gasse|ring\b|ufer|br(ü|ue)cke|schule|halle|bad\b|markt|graben"
ATTACHMENT = r"^(anlage|plan\b|lageplan|karte|foto|bild|abwaegung|abw(ä|ae)gung|schalltechn|verkehrsunters|klimaanalyse|gutachten|tabelle|kalkulation|uebersicht|übersicht)"
ANSWER, QUESTION = r"stellungnahme|beantwortung|\bantwort\b", r"^(anfrage|frage)\b"
ASSERTED_OUTCOME = r"\b(hat beschlossen|wurde beschlossen|ist beschlossen|hat entschieden|wurde entschieden|beschloss)\b"
SHORT_HEADING, SHORT_TITLE = 22, 12


def any_match(text: Column, patterns, flags: str = "(?iU)") -> Column:
    """Whether one of a few patterns is found, in all scripts and either case."""
    return known(text).rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def tags(text: Column, table, flags: str | None = None) -> Column:
    """Labels of all rules that match, in the table's order, each once: in one pass for all rules, or with flags pattern by pattern."""
    if flags is None:
        return labels_found(known(text), table)
    return F.array_distinct(F.array_compact(F.array(*[F.when(known(text).rlike(flags + p), F.lit(label)) for p, label in table])))


def is_routine(title: Column) -> Column:
    return any_found(known(title), ROUTINE)


def is_holding_body(body: Column) -> Column:
    return any_match(body, [HOLDING_BODY])


def is_collective_heading(title: Column) -> Column:
    return (F.length(known(title)) < SHORT_HEADING) & ~any_match(title, [PLACE_WORD])


def is_short(title: Column) -> Column:
    return F.length(known(title)) < SHORT_TITLE


def asserted_outcome(text: Column) -> Column:
    """The first phrase that claims a decision was taken, '' if none."""
    return F.regexp_extract(known(text), f"(?iU){ASSERTED_OUTCOME}", 0)


def main_documents(documents: Column) -> Column:
    return F.filter(documents, lambda d: ~known(d["title"]).rlike(f"(?iU){ATTACHMENT}"))


def prioritised(documents: Column) -> Column:
    """Answers, then the rest, then mere questions; the given order where there is no answer."""
    answer = lambda d: known(d["title"]).rlike(f"(?iU){ANSWER}")
    question = lambda d: known(d["title"]).rlike(f"(?iU){QUESTION}")
    ordered = F.concat(F.filter(documents, answer), F.filter(documents, lambda d: ~answer(d) & ~question(d)), F.filter(documents, lambda d: ~answer(d) & question(d)))
    return F.when(F.exists(documents, answer), ordered).otherwise(documents)
