"""Surrogates for personal data, with DataFrame functions alone (no Python on the executors).

Mentions are found by one alternation of patterns.  A mention's canonical form
(digits of a number, lower-case address, gender and last name word) names the entity,
so all mentions of an entity, in whatever format, share one surrogate; a phone number's
country code +1 is no part of it.  Surrogates come from a keyed SHA-512 of kind,
canonical form and attempt, and keep what makes the entity plausible: country code and
line format of phones, the 0 of national ones, issuer digit and a valid check digit of
cards, country and valid check digits of bank account numbers, octet ranges and groups
of addresses, letter case, digits and punctuation of e-mail addresses with their
top-level domain, script, hyphens and capitals of names, and gender (titles stay, and
given names end by it).

A person is one or more titles (of address, academic, and roles after them, which all
stay) and all capitalised name words that follow, with particles.  The first title that
has a gender gives it; a person without one takes that of the document's first person
of the same surname, else none.  Later words of the document that are a known name word
of a person, alone or with an s, get its surrogate: a word belongs to the first person
that has it.  A name that is also an ordinary word is thus replaced there as well.
Names without any title are not detected.  Names in Cyrillic and Greek letters get such
surrogates, all others Latin ones.

Sixteen digits in a card's layout are a card, other lengths from 13 to 19 by their check
digit only.  A bank account number with wrong check digits stays, and so do the digits
within it.

Distinctness is checked over the whole corpus: two entities of a kind with one
surrogate, or a surrogate that is itself an entity of the corpus, make the later
entity try again with the next attempt, until no collision is left.

Documents without mentions are not shuffled; those with mentions are written to the
shared folder once, so the corpus is searched twice, for each of the two.  Mentions
meet surrogates in a join on (kind, entity), later words meet their names in a join on
(text, word); the pieces are put together by text, so copies are rebuilt once, in a
time that grows with the mentions and words of a text.  Null texts stay null; empty
ones stay empty.  Columns of the input named n_entities or kinds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, numbered, partitions, position

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Titles of address by gender, academic titles with their additions, and roles that follow a title.
_HER = "Mrs|Ms|Miss|Frau|Fräulein|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Sra|Srta|Госпожа|Κυρία"
_HIS = "Mr|Herrn|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
_ACADEMIC = r"Dr\.-Ing|Dipl\.-\p{Lu}\p{L}++|Professorin|Professor|Prof|Doktor|Doctor|Dr|Ing(?=\.)|Mag(?=\.)"
_ADDED = r"(?:(?:med|dent|vet|rer|nat|phil|jur|iur|pol|oec|theol|habil|mult|em|h|c)\.[ ]?)*+"
_ROLES = "(?:President|Chairman|Chairwoman|Chair|Speaker|Secretary|Minister|Ministerin|Mayor|Ambassador|Judge|Präsidentin|Präsident|Vorsitzende|Vorsitzender|Oberbürgermeisterin|Oberbürgermeister|Bürgermeisterin|Bürgermeister|Kanzlerin|Kanzler|Direktorin|Direktor|Président|Présidente|Presidente|Presidenta|Ministre|Maire|Alcalde|Alcaldesa)"
_TITLE = rf"(?:{_HER}|{_HIS}|{_ACADEMIC})\.?[ ]{_ADDED}"
_TITLES = rf"{_TITLE}(?:{_TITLE}|{_ROLES}[ ])*+"
# Words of a name with inner capitals, hyphens and apostrophes, and the particles between them.
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:(?:-|['’](?!s(?!\p{L})))[\p{L}\p{M}]++)*+"
_NAME = rf"(?!{_TITLE}|(?:{_HER}|{_HIS}|{_ACADEMIC}|{_ROLES})(?!\p{{L}}))(?:\p{{Lu}}\.(?=[ ]|\z)|{_WORD})"
_PARTICLE = r"(?:von|van|vom|zu|zur|zum|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|al|el|bin|ibn)"
#: Later words that may be a known name.
_LATER = rf"(?<![\p{{L}}\p{{M}}’'-]){_WORD}(?!-?[\p{{L}}\p{{M}}])"

_HEX = "[0-9A-Fa-f]{1,4}"
# The kinds of entities and their patterns, in order of precedence.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.,/-])(?:\(0[1-9][0-9]{1,4}\)[ ]?|0[1-9][0-9]{1,4}(?:[ ]?/[ ]?|[ ]))(?:[0-9]{5,9}|[0-9]{2,4}(?:[ -][0-9]{2,4}){1,3})(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[0-9]{12}|(?:[ ][0-9]{4}){3}|(?:-[0-9]{4}){3})|[0-9]{4}[ ][0-9]{6}[ ][0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("ip", rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("ip6", rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:{_HEX}(?::{_HEX}){{7}}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z:])"),
    ("person", rf"(?<!\p{{L}}){_TITLES}(?:{_PARTICLE}[ ])*{_NAME}(?:[ ](?:{_PARTICLE}[ ])*{_NAME})*+(?!\p{{L}})"),
)
_ONE = {kind: f"(?:{pattern})" for kind, pattern in KINDS}
#: All kinds; numbers, addresses in groups and capitals are only tried where one begins.
PATTERN = f"{_ONE['email']}|(?=[0-9+(])(?:{_ONE['phone']}|{_ONE['card']}|{_ONE['ssn']}|{_ONE['ip']})|(?=[A-ZГΚ])(?:{_ONE['iban']}|{_ONE['person']})|(?={_HEX}:){_ONE['ip6']}"

# What names are made of, by script: beginnings of syllables, vowels, ends of surnames, ends of given names (hers, his, neither).
_SOUNDS = {
    "Latin": ("b br d dr f g gr h j k kl l m n p r s st t tr v w z".split(), "a e i o u ei au".split(), "n r l s m nd rt ck".split(), ("na", "n", "e")),
    "Cyrillic": ("б бр в г гр д др ж з к л м н п р с ст т тр ф х ч ш".split(), "а е и о у я ю".split(), "н р л с м нов рев кин".split(), ("на", "н", "е")),
    "Greek": ("β γ γρ δ δρ ζ θ κ κλ λ μ ν ξ π πρ ρ σ στ τ τρ φ χ ψ".split(), "α ε ι ο υ ει αυ".split(), "ς νης ρας λος δης κος της νος".split(), ("να", "ν", "ε")),
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern matches the whole mention."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        # look-around holds at both ends of a mention
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    # numbers of other lengths than 16 are cards by their check digit only
    digits = _digits(mention)
    wrong = (out == "card") & (F.length(digits) != 16) & (luhn_sum(digits) % 10 != 0)
    account = F.replace(mention, F.lit(" "), F.lit(""))
    return F.when(wrong | ((out == "iban") & (mod_97(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))) != 1)), None).otherwise(out)


def name_parts(mention: Column) -> Column:
    """The mention of a person in parts of one name word each, with the titles and particles before it."""
    return F.regexp_extract_all(mention, F.lit(rf"(?:^{_TITLES})?(?:{_PARTICLE}[ ])*{_NAME}"), F.lit(0))


def gender_of(mention: Column) -> Column:
    """f:, m: or, where no title tells, n:"""
    first = F.regexp_extract(mention, rf"^(?:(?:{_ACADEMIC})\.?[ ]{_ADDED}|{_ROLES}[ ])*?({_HER}|{_HIS}|Professorin)(?!\p{{L}})", 1)
    return F.when(first.rlike(f"^(?:{_HER}|Professorin)$"), "f:").when(first != "", "m:").otherwise("n:")


def canonical(kind: Column, mention: Column, gender: Column) -> Column:
    name = F.lower(F.regexp_extract(mention, r"([^ ]+)$", 1))
    return F.when(kind == "email", F.lower(mention)).when(kind == "person", F.concat(gender, name)).when(kind == "given", F.concat(gender, name)).when(kind == "ip", mention).when(kind == "ip6", F.lower(mention)).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind == "phone", F.regexp_replace(_digits(mention), "^1(?=[0-9]{10}$)", "")).otherwise(_digits(mention))


def _byte(seed: Column, i: Column) -> Column:
    """Byte i of a hexadecimal seed (128 characters, read round)."""
    return F.conv(F.substring(seed, (2 * i) % 126 + 1, F.lit(2)), 16, 10).cast("int")


def _like(text: Column, seed: Column) -> Column:
    """Letters and digits replaced by others of their class; all else stays."""
    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        letter = lambda base: F.chr(base + _byte(seed, i) % 26)
        return F.when(c.rlike("[a-z]"), letter(97)).when(c.rlike("[A-Z]"), letter(65)).when(c.rlike("[0-9]"), (_byte(seed, i) % 10).cast("string")).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of a number whose last digit counts once (the check digit's place)."""
    def one(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = 2 * d
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), one)


def mod_97(text: Column) -> Column:
    """The remainder of digits and capitals (A = 10 to Z = 35) read as one number."""
    def one(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), one)


def _like_hex(text: Column, seed: Column) -> Column:
    """Hexadecimal digits replaced by others, none by a 0; the first stays."""
    one = lambda i: F.when((i > 1) & (F.substring(text, i, F.lit(1)) != ":"), F.lower(F.hex((_byte(seed, i) % 15 + 1).cast("long")))).otherwise(F.substring(text, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def _name(name: Column, gender: Column, seed: Column, attempt: Column, given: Column) -> Column:
    """A lower-case name for a lower-case name, of its script and with its hyphens."""

    def made(script: str) -> Column:
        begins, vowels, ends, by_gender = (F.array(*map(F.lit, x)) for x in _SOUNDS[script])
        pick = lambda of, i: F.element_at(of, _byte(seed, i) % F.size(of) + 1)
        end = F.element_at(by_gender, F.when(gender == "f:", 1).when(gender == "m:", 2).otherwise(3))

        def one(part: Column, k: Column) -> Column:
            syllables = F.transform(F.sequence(F.lit(0), F.lit(1) + attempt), lambda i: F.concat(pick(begins, 11 * k + 2 * i), pick(vowels, 11 * k + 2 * i + 1)))
            return F.concat(F.array_join(syllables, ""), F.when(given, end).otherwise(pick(ends, 11 * k + 10)))

        return F.array_join(F.transform(F.split(name, "-"), one), "-")

    return F.when(name.rlike(r"\p{IsCyrillic}"), made("Cyrillic")).when(name.rlike(r"\p{IsGreek}"), made("Greek")).otherwise(made("Latin"))


def surrogate(kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """The surrogate's canonical form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string"), F.lit(key)), 512)
    number = _like(entity, seed)
    body = F.concat(F.substring(entity, 1, 1), F.substring(number, F.lit(2), F.length(entity) - 2))
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(luhn_sum(entity) % 10 == 0, F.concat(body, check)).otherwise(F.concat(body, F.substring(number, -1, 1)))
    national = F.length(entity) - 10
    area = (_byte(seed, F.lit(40)) % 8 + 2).cast("string")
    phone = F.when(entity.startswith("0"), F.concat(F.lit("0"), area, F.substring(number, F.lit(3), F.length(entity)))).when(national >= 0, F.concat(F.substring(entity, F.lit(1), national), area, F.substring(number, national + 2, F.lit(9)))).otherwise(F.concat(F.substring(entity, 1, 2), F.substring(number, F.lit(3), F.length(entity))))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(seed, i) % 254 + 1).cast("string")), ".")
    top = F.regexp_extract(entity, r"(\.[a-z]+)$", 1)
    mail = F.concat(_like(F.substring(entity, F.lit(1), F.length(entity) - F.length(top)), seed), top)
    person = F.concat(F.substring(entity, 1, 2), _name(F.substring(entity, F.lit(3), F.length(entity)), F.substring(entity, 1, 2), seed, attempt, kind == "given"))
    inner = F.substring(number, F.lit(5), F.length(entity))
    account = F.concat(F.substring(entity, 1, 2), F.lpad((98 - mod_97(F.concat(inner, F.substring(entity, 1, 2), F.lit("00")))).cast("string"), 2, "0"), inner)
    return F.when(kind == "email", mail).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", octets).when(kind == "ip6", _like_hex(entity, seed)).when(kind == "iban", account).when(kind.isin("person", "given"), person).otherwise(number)


def rendered(kind: Column, mention: Column, entity: Column) -> Column:
    """A surrogate in the format of the mention it replaces; digits before the entity's own stay."""
    before = F.length(_digits(mention)) - F.length(entity)

    def digit(i: Column) -> Column:
        c = F.substring(mention, i, F.lit(1))
        nth = F.length(_digits(F.substring(mention, F.lit(1), i))) - before
        return F.when(c.rlike("[0-9]") & (nth > 0), F.substring(entity, nth, F.lit(1))).otherwise(c)

    def sign(i: Column) -> Column:
        c = F.substring(mention, i, F.lit(1))
        nth = F.length(F.replace(F.substring(mention, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(entity, nth, F.lit(1)))

    account = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), sign), "")

    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), digit), "")
    def cased(i: Column) -> Column:
        c = F.substring(entity, i, F.lit(1))
        return F.when(F.substring(mention, i, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)

    mail = F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), cased), "")
    old, new = _last_word(mention), F.substring(entity, F.lit(3), F.length(entity))
    capitals = (F.length(old) > 1) & (F.upper(old) == old) & ~old.endswith(".")
    new = F.when(capitals, F.upper(new)).otherwise(F.array_join(F.transform(F.split(new, "-"), F.initcap), "-"))
    person = F.concat(F.regexp_extract(mention, r"^(.*[ ])?[^ ]+$", 1), new)
    return F.when(kind == "email", mail).when(kind.isin("person", "given"), person).when(kind.isin("ip", "ip6"), entity).when(kind == "iban", account).otherwise(number)


def _last_word(name: Column) -> Column:
    return F.regexp_extract(name, r"([^ ]+)$", 1)


def assign(entities: DataFrame, key: str, rounds: int = 30) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): distinct within a kind, and no entity itself."""
    # few bytes, but many hashes: not left to one task
    entities = entities.repartition(partitions(entities.sparkSession), "kind", "entity")
    now = checkpoint(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), key, F.lit(0))))
    taken = now.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(rounds):
        first = now.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.count("*").alias("n"))
        clash = first.join(taken, ["kind", "surrogate"], "left").where("n > 1 or real")
        again = now.join(clash, ["kind", "surrogate"]).where("real or entity <> first").select("kind", "entity", F.lit(1).alias("more"))
        again = checkpoint(again)
        if again.isEmpty():
            return now.select("kind", "entity", "surrogate")
        tried = now.join(again, ["kind", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0)))
        now = checkpoint(tried.select("kind", "entity", "attempt", F.when(F.col("more").isNull(), F.col("surrogate")).otherwise(surrogate(F.col("kind"), F.col("entity"), key, F.col("attempt"))).alias("surrogate")))
    raise RuntimeError("surrogates still collide; use another key")


def _later_words(some: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(_key, gaps): the text between the mentions of persons' texts, with known name words replaced."""
    names = known.where(F.col("kind").isin("person", "given")).select("_key", "pos", "part", _last_word(F.col("mention")).alias("old"), _last_word(F.col("new")).alias("new"))
    forms = F.explode(F.array(F.struct(F.lit(0).alias("form"), "old", "new"), F.struct(F.lit(1).alias("form"), F.concat("old", F.lit("s")).alias("old"), F.concat("new", F.lit("s")).alias("new"))))
    forms = names.where(~F.col("old").endswith(".")).select("_key", "pos", "part", forms.alias("f")).groupBy("_key", F.col("f.old").alias("word")).agg(F.min(F.struct("f.form", "pos", "part", "f.new"))["new"].alias("new"))
    texts = some.select("_key", text).join(names.select("_key").distinct(), "_key").dropDuplicates(["_key"])
    gaps = texts.select("_key", F.posexplode(F.split(F.col(text), PATTERN, -1)).alias("gap", "between"))
    gaps = gaps.select("_key", "gap", F.split("between", _LATER, -1).alias("rest"), F.regexp_extract_all("between", F.lit(_LATER), F.lit(0)).alias("words"))
    words = gaps.where(F.size("words") > 0).select("_key", "gap", F.posexplode("words").alias("nth", "word"))
    words = words.join(forms, ["_key", "word"], "left").groupBy("_key", "gap").agg(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("new", "word").alias("new")))).alias("words"))
    whole = F.array_join(F.concat(F.array(F.element_at("rest", 1)), F.zip_with(F.slice(F.col("rest"), F.lit(2), F.size("rest")), "words", lambda rest, w: F.concat(w["new"], rest))), "")
    done = gaps.select("_key", "gap", "rest").join(words, ["_key", "gap"], "left").select("_key", "gap", F.when(F.col("words").isNull(), F.element_at("rest", 1)).otherwise(whole).alias("between"))
    return done.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("gap", "between"))).alias("gaps"))


def replace_pii(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """The columns of docs with surrogates in the text, and n_entities (mentions replaced) and kinds (their sorted kinds)."""
    text = position(docs, text_col)
    rows = numbered(docs)
    has = F.coalesce(F.col(text).rlike(PATTERN), F.lit(False))
    mentions = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    some = checkpoint(rows.where(has).withColumns({"_key": F.sha2(F.col(text), 256), "_found": mentions}))
    each = some.select("_key", F.posexplode("_found").alias("pos", "mention")).distinct()
    each = each.withColumn("kind", kind_of(F.col("mention")))
    # who has no gender by title has that of the text's first person of the surname
    each = each.withColumn("gender", gender_of(F.col("mention"))).withColumn("surname", F.when(F.col("kind") == "person", F.lower(_last_word(F.col("mention")))))
    told = each.where("surname is not null and gender <> 'n:'").groupBy("_key", "surname").agg(F.min(F.struct("pos", "gender"))["gender"].alias("told"))
    each = each.join(told, ["_key", "surname"], "left").withColumn("gender", F.when(F.col("gender") == "n:", F.coalesce("told", "gender")).otherwise(F.col("gender")))
    # a person's last name word is the key of the entity; each further word has a surrogate of its own
    parts = F.when(F.col("kind") == "person", name_parts(F.col("mention"))).otherwise(F.array("mention"))
    each = each.select("_key", "pos", "kind", "gender", F.size(parts).alias("n"), F.posexplode(parts).alias("part", "mention"))
    each = each.withColumn("kind", F.when((F.col("kind") == "person") & (F.col("part") < F.col("n") - 1), "given").otherwise(F.col("kind")))
    each = each.select("_key", "pos", "part", "mention", "kind", canonical(F.col("kind"), F.col("mention"), F.col("gender")).alias("entity"))
    each = checkpoint(each)
    known = each.where("kind is not null")
    named = assign(known.select("kind", "entity").distinct(), key)
    new = known.join(named, ["kind", "entity"], "left").withColumn("new", F.coalesce(rendered(F.col("kind"), F.col("mention"), F.col("surrogate")), F.col("mention")))
    new = checkpoint(new.select("_key", "pos", "part", "kind", "mention", "new"))
    later = _later_words(some, text, new)
    new = new.unionByName(each.where("kind is null").select("_key", "pos", "part", "kind", "mention", F.col("mention").alias("new")))
    per = new.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "new"))).alias("words"), F.array_sort(F.collect_set(F.when(F.col("kind") == "given", "person").otherwise(F.col("kind")))).alias("kinds"), F.count_if((F.col("part") == 0) & F.col("kind").isNotNull()).alias("n_entities"))
    # the words of a mention are joined by spaces again; no mention holds a null character
    joined = F.array_join(F.transform("words", lambda w: F.concat(F.when(w["part"] == 0, "\0").otherwise(" "), w["new"])), "")
    joined = F.split(F.regexp_replace(joined, r"^\x00", ""), r"\x00", -1)
    per = per.select("_key", "kinds", "n_entities", joined.alias("news")).join(later, "_key", "left")
    pieces = F.coalesce(F.transform("gaps", lambda g: g["between"]), F.split(F.col(text), PATTERN, -1))
    whole = F.array_join(F.concat(F.flatten(F.zip_with(F.slice(pieces, 1, F.size("news")), F.col("news"), lambda a, b: F.array(a, b))), F.slice(pieces, F.size(pieces), 1)), "")
    done = some.join(per, "_key").withColumn(text, whole)
    kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c not in ("n_entities", "kinds")]
    names = [c for c, _ in kept]
    changed = done.select(*names, "n_entities", "kinds")
    clean = rows.where(~has).select(*names, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    out = changed.unionByName(clean)
    return out.toDF(*[c for _, c in kept], "n_entities", "kinds")
