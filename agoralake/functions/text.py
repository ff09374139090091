"""Text functions as column expressions: HTML fragments, dates, titles, names, keys.

Missing text is the empty string throughout, as in the records; a null input counts as ''.
Patterns use (?U), since word, space and case classes are meant for all of Unicode.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that plain SQL decodes, the ampersand last.
SQL_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

#: White space in the patterns of plain SQL, whose letters and digits are ASCII too.
SQL_SPACE = r"[\t\n\f\r ]"
SQL_WORD = r"[\w\x{17F}\x{212A}]"  # without case, the long s and the Kelvin sign are an s and a k

# What a plain title does without, in this order.
TITLE_REMOVALS = (
    r"^Vollzug des Bayerischen Stra(ß|ss)en-\s*und Wegegesetzes\s*[—-]*\s*",
    r"^Vollzug\s+(?:des|der)\s+[^—]{5,60}?\s*[—-]+\s*",
    r"\s*gem(ä|ae)?(ß|ss)?\.?\s*(Art\.|§)\s*[\w\s.,/§-]{2,60}",
    r"\s*\(\s*Art\.\s*[^)]{2,40}\)",
    r"\s*nach\s+dem\s+Baugesetzbuch",
    r"^\s*•\s*",
    r"\s*\(\s*AZ:?\s*[\d/-]+\s*\)",
    r"^\s*\d{4}-\d{2}-\d{3,4}\s+",
)
TITLE_SEPARATORS = (" — ", "; ", " – ")
LEAST_HEAD, MOST_TITLE = 25, 110

# Names of persons in an item's suffix.
SPEAKER = r"(Referent(en|in|innen)?|Vortrag(ende[rn]?)?|Berichterstatter(in)?)\s*:.*"
TITLED_NAME = r"\b(Herr|Frau|Dr\.|Prof\.)\s+\S+"

# A date as it is shown, and a district in the name of its committee.
SHOWN_DATE = r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$"
DISTRICT = r"(?U)Bezirksausschuss\s+([IVX]+\s*-\s*.+)$"

# Month names.
MONTHS = ("Januar", "Februar", "Maerz", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")


def known(x: Column) -> Column:
    """'' for null."""
    return F.coalesce(x, F.lit(""))


def _strip(x: Column, characters: str) -> Column:
    return F.trim(x, F.lit(characters))


def squeeze(x: Column, space: str = r"(?U)\s") -> Column:
    """White space (no-break space too, if of all of Unicode) collapsed and trimmed."""
    collapsed = F.regexp_replace(x, f"{space}+", " ")
    # plain SQL trims every space separator
    return F.regexp_replace(collapsed, r"^\p{Zs}+|\p{Zs}+\z", "") if space == SQL_SPACE else F.trim(collapsed)


def strip_tags(x: Column, space: str = r"\s") -> Column:
    return F.regexp_replace(F.regexp_replace(known(x), f"<br{space}*/?>", " — "), r"<[^>]+>", "")


#: A reference that needs the standard library's table; tags may stand in it before they are stripped.
OTHER_ENTITY = "&(?!(?:" + "|".join(name[1:-1] for name, _ in SQL_ENTITIES) + ");)[#A-Za-z<]"


def _unescape(values: pd.Series) -> pd.Series:
    from html import unescape

    return values.map(unescape, na_action="ignore")


def _unescape_each(values: pd.Series) -> pd.Series:
    from html import unescape

    return values.map(lambda found: [unescape(x) for x in found], na_action="ignore")


def _replaced(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for name, value in pairs:
        x = F.replace(x, F.lit(name), F.lit(value))
    return x


def _few_entities(x: Column) -> Column:
    return _replaced(x, SQL_ENTITIES)


def unescaped(x: Column, raw: Column | None = None) -> Column:
    """x with every named and numeric entity decoded once; only texts with other entities than SQL_ENTITIES (judged by raw, if given) go to Python."""
    other = F.when((x if raw is None else raw).rlike(OTHER_ENTITY), x)
    return F.coalesce(F.pandas_udf(_unescape, "string")(other), _few_entities(x))


def unescaped_each(xs: Column) -> Column:
    """unescaped for the elements of an array, none of them null."""
    other = F.when(F.exists(xs, lambda x: x.rlike(OTHER_ENTITY)), xs)
    return F.coalesce(F.pandas_udf(_unescape_each, "array<string>")(other), F.transform(xs, _few_entities))


def html_text(x: Column, entities: tuple[tuple[str, str], ...] | None = None) -> Column:
    """Readable text of an HTML fragment; entities are decoded after the tags are gone, so escaped markup stays.

    All of HTML's are decoded, some of them without their semicolon too (a text cut off within "&amp;"),
    or, as by plain SQL, only the given pairs of name and value, in their order, and SQL_SPACE is all white space.
    """
    if entities is None:
        decoded, space = unescaped(strip_tags(x), known(x)), r"(?U)\s"
    else:
        decoded, space = _replaced(strip_tags(x, SQL_SPACE), entities), SQL_SPACE
    return squeeze(F.replace(decoded, F.lit("\u00a0"), F.lit(" ")), space)


def html_texts(xs: Column) -> Column:
    """html_text for the elements of an array."""
    return F.transform(unescaped_each(F.transform(xs, strip_tags)), lambda x: squeeze(F.replace(x, F.lit("\u00a0"), F.lit(" "))))


def absolute_url(url: Column, base: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(base, F.lit("/"), F.ltrim(url, F.lit("/"))))


def iso_date(display: Column) -> Column:
    """DD.MM.YYYY as YYYY-MM-DD by its letters alone; anything else is ''."""
    return F.when(known(display).rlike(SHOWN_DATE), F.regexp_replace(display, SHOWN_DATE, "$3-$2-$1")).otherwise("")


def display_date(iso: Column) -> Column:
    """YYYY-MM-DD as DD.MM.YYYY; anything that has not three parts stays."""
    parts = F.split(iso, "-")
    return F.when(F.size(parts) == 3, F.concat_ws(".", F.get(parts, F.lit(2)), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(iso)


def date_number(iso: Column) -> Column:
    """YYYYMMDD as a number, 0 when blank."""
    return F.coalesce(F.regexp_replace(iso, "-", "").try_cast("long"), F.lit(0)).cast("long")


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), number)


def plain_title(title: Column, sql: bool = False) -> Column:
    """A readable line of an official title: citations and file numbers go, long ones are cut.

    With sql, classes in the patterns are those of plain SQL instead of Unicode's, and null stays null.
    """
    t, space = (title, SQL_SPACE) if sql else (known(title), r"(?U)\s")
    for pattern in TITLE_REMOVALS:
        t = F.regexp_replace(t, "(?iu)" + pattern.replace(r"\s", SQL_SPACE).replace(r"\w", SQL_WORD) if sql else f"(?iU){pattern}", " ")
    cut = t
    for separator in reversed(TITLE_SEPARATORS):
        head = _strip(F.substring_index(t, separator, 1), " ;,–—-")
        cut = F.when(F.contains(t, F.lit(separator)) & (F.length(head) >= LEAST_HEAD), head).otherwise(cut)
    cut = _strip(squeeze(cut, space), " ;,:–—-")
    short = F.regexp_replace(F.substring(cut, 1, MOST_TITLE), " [^ ]*$", "")
    return F.when(F.length(cut) > MOST_TITLE, F.concat(short, F.lit(" …"))).otherwise(cut)


def without_persons(suffix: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(known(suffix), f"(?isU){SPEAKER}", ""), f"(?U){TITLED_NAME}", ""), r"(?U)^\s+|\s+$", "")


def district_of(body: Column) -> Column:
    """[district] of a district committee, [] of other bodies."""
    found = F.regexp_extract(known(body), DISTRICT, 1)
    name = F.regexp_replace(F.regexp_replace(found, r"(?U)\s*-\s*", "-"), r"(?U)^\s+|\s+$", "")
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.array(name))


def collapse_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\n{3,}", "\n\n")


def page_cache_key(base: Column, path: Column) -> Column:
    """Name of a cached page: instance, then the path in safe characters, cut after 140."""
    instance = F.regexp_extract(F.rtrim(base, F.lit("/")), r"([^/]*)$", 1)
    return F.concat(instance, F.lit("_"), F.left(F.regexp_replace(path, r"[^A-Za-z0-9_.-]", "_"), F.lit(140)), F.lit(".html"))


def pdf_cache_key(url: Column) -> Column:
    return F.concat(F.right(F.regexp_replace(url, r"[^A-Za-z0-9]", "_"), F.lit(120)), F.lit(".pdf"))


def approximate_tokens(characters: Column) -> Column:
    return F.floor(characters / 4).cast("long")
