"""PII surrogates and WARC derivatives."""

import base64
import hashlib
import random
import re
import unicodedata
from html.parser import HTMLParser

import pytest
import regex
from pyspark.sql import functions as F

from agoralake.llm import queries, surrogates, warc

from .conftest import SF

# -- surrogates


def replaced(docs, key="k"):
    return {r["doc_id"]: r for r in surrogates.replace_pii(docs, key=key).collect()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


TEXTS = [
    (1, "Write to Ann.Lee@mail.example.com or ann.lee@MAIL.example.com now."),
    (2, "Call (555) 123-4567, 555-123-4567 or +1 555 123 4567!"),
    (3, "Card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 12345."),
    (4, "SSN 123-45-6789; host 10.0.0.12"),
    (5, "Mrs. Miller met Herr Weber; Mr. Miller and Господин Иванов did not. Mrs. Miller left."),
    (6, "Nothing to see: 3.14 and a@b"),
    (7, None),
    (8, ""),
    (9, "ann.lee@mail.example.com again"),
]


def test_surrogates_keep_type_format_and_coreference(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    found = replaced(docs)
    mails = re.findall(r"[A-Za-z.]+@[A-Za-z.]+", found[1]["text"])
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() != "ann.lee@mail.example.com"
    assert mails[0].endswith(".com") and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[a-z]{4}\.[a-z]{7}\.com", mails[0]) and "@MAIL" not in found[1]["text"]
    assert found[9]["text"].split()[0] == mails[0].lower()
    assert re.fullmatch(r"Call \(\d{3}\) \d{3}-\d{4}, \d{3}-\d{3}-\d{4} or \+1 \d{3} \d{3} \d{4}!", found[2]["text"])
    one, two = re.findall(r"\(?\d{3}\)?[ -]\d{3}[ -]\d{4}", found[2]["text"])[:2]
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "5551234567"
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", found[3]["text"])]
    assert len(cards) == 2 and cards[0] == cards[1] != "4111111111111111" and cards[0][0] == "4" and luhn(cards[0]) and found[3]["text"].endswith("not 12345.")
    assert re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}; host \d+\.\d+\.\d+\.\d+", found[4]["text"]) and "123-45-6789" not in found[4]["text"] and "10.0.0.12" not in found[4]["text"]
    names = re.fullmatch(r"Mrs\. ([A-Z][a-z]+) met Herr ([A-Z][a-z]+); Mr\. ([A-Z][a-z]+) and Господин ([А-Я][а-я]+) did not\. Mrs\. ([A-Z][a-z]+) left\.", found[5]["text"]).groups()
    assert names[0] == names[4] and len({*names[:4], "Miller", "Weber", "Иванов"}) == 7
    assert [found[d]["text"] for d in (6, 7, 8)] == ["Nothing to see: 3.14 and a@b", None, ""] and found[6]["n_entities"] == 0
    assert found[5]["n_entities"] == 5 and found[4]["kinds"] == ["ip", "ssn"]


def test_whole_names_and_cards_of_all_lengths(spark):
    texts = [(1, "Mr. John Smith met Mr. Smith and Ms. Ann O'Brien. Herr Karl von Smith-Jones saw Mr. J. McDonald, Mrs. MILLER Mr. Smith's cat."), (2, "Amex 378282246310005, 3782 822463 10005, not 378282246310006.")]
    found = replaced(spark.createDataFrame(texts, "doc_id bigint, text string"))
    one = found[1]["text"]
    assert not re.search("John|Smith|Jones|Ann|Brien|Karl|Donald|MILLER|J[.]", one) and found[1]["n_entities"] == 7 and found[1]["kinds"] == ["person"]
    first = re.match(r"Mr\. ([A-Z][a-z]+) ([A-Z][a-z]+) met Mr\. ([A-Z][a-z]+) and Ms\. [A-Z][a-z]+ [A-Z][a-z]+\. Herr [A-Z][a-z]+ von [A-Z][a-z]+-[A-Z][a-z]+ saw Mr\. [A-Z][a-z]+ [A-Z][a-z]+, Mrs\. [A-Z]+ Mr\. ([A-Z][a-z]+)'s cat\.$", one)
    assert first and first[2] == first[3] == first[4] != first[1]
    cards = re.match(r"Amex (\d{15}), (\d{4} \d{6} \d{5}), not 378282246310006\.$", found[2]["text"])
    assert cards and cards[1] == cards[2].replace(" ", "") != "378282246310005" and luhn(cards[1]) and found[2]["n_entities"] == 2


def remainder_97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def letter(c):
    return unicodedata.category(c)[0] == "L"


def person_at(text, i):
    """Where the person that begins at i ends, and its parts (first name word with all titles before it), read letter by letter; or None."""
    her = "Mrs Ms Miss Frau Fräulein Madame Mademoiselle Mme Mlle Señora Señorita Sra Srta Госпожа Κυρία".split()
    his = "Mr Herr Herrn Monsieur Señor Sr Господин Κύριος".split()
    academic = "Dr Prof Professor Professorin Doktor Doctor".split()
    roles = "President Chairman Chairwoman Chair Speaker Secretary Minister Ministerin Mayor Ambassador Judge Präsidentin Präsident Vorsitzende Vorsitzender Oberbürgermeisterin Oberbürgermeister Bürgermeisterin Bürgermeister Kanzlerin Kanzler Direktorin Direktor Président Présidente Presidente Presidenta Ministre Maire Alcalde Alcaldesa".split()
    small = "von van vom zu zur zum der den de del della di da dos du la le ten ter al el bin ibn".split()
    if i and letter(text[i - 1]):
        return None

    def word(at):
        end = at
        while end < len(text) and letter(text[end]):
            end += 1
        return text[at:end]

    def title_word(at):
        """A title at a place without what follows it, and its end."""
        w = word(at)
        end = at + len(w)
        if text.startswith("Dr.-Ing", at) and not letter(text[at + 7 : at + 8] or " "):
            return "Dr", at + 7
        if w == "Dipl" and text.startswith(".-", end) and len(word(end + 2)) > 1 and word(end + 2)[0].isupper():
            return "Dr", end + 2 + len(word(end + 2))
        if w in ("Ing", "Mag") and text.startswith(".", end):
            return "Dr", end
        return (w, end) if w in her + his + academic else None

    def title(at):
        """The end of the title at a place, and its gender."""
        w, end = title_word(at) or (None, None)
        if not w:
            return None
        end += text.startswith(".", end)
        if not text.startswith(" ", end):
            return None
        end += 1
        while word(end) in "med dent vet rer nat phil jur iur pol oec theol habil mult em h c".split() and text.startswith(".", end + len(word(end))):
            end += len(word(end)) + 1
            end += text.startswith(" ", end)
        return end, "f:" if w in her or w == "Professorin" else "m:" if w in his else None

    def name(at):
        """The end of the name word at a place."""
        if title_word(at) or word(at) in roles or at >= len(text) or unicodedata.category(text[at]) != "Lu":
            return None
        if text[at + 1 : at + 3] == ". " or text[at + 1 :] == ".":
            return at + 2
        inside = lambda k: k < len(text) and unicodedata.category(text[k])[0] in "LM"
        end = at
        while True:
            while inside(end):
                end += 1
            if end < len(text) and text[end] in "-'’" and inside(end + 1) and not (text[end] != "-" and text[end + 1] == "s" and not (end + 2 < len(text) and letter(text[end + 2]))):
                end += 1
                continue
            return end

    def with_small(at):
        while word(at) in small and text.startswith(" ", at + len(word(at))):
            at += len(word(at)) + 1
        return name(at)

    at, gender = title(i) or (None, None)
    if at is None:
        return None
    while True:
        more = title(at)
        if more:
            at, gender = more[0], gender or more[1]
        elif word(at) in roles and text.startswith(" ", at + len(word(at))):
            at += len(word(at)) + 1
        else:
            break
    end = with_small(at)
    if end is None:
        return None
    parts, last = [text[i:end]], end
    while text.startswith(" ", last) and (end := with_small(last + 1)):
        parts.append(text[last + 1 : end])
        last = end
    return last, parts, gender or "n:"


class Brute:
    """The same task in plain Python: mentions one by one, persons by their letters, entities by dictionaries."""

    def __init__(self, rows):
        self.rows = [(d, t, list(self.mentions(t or ""))) for d, t in rows]

    def mentions(self, text):
        """(start, end, [(kind, entity, text)]), the parts of persons apart."""
        numbers = [(k, regex.compile(p)) for k, p in surrogates.KINDS if k != "person"]
        at, found = 0, []
        for m in re.finditer(r"[0-9+(]|(?<![A-Za-z0-9._%+-])[A-Za-z._%+-]|(?<![^\W\d_])[^\W\d_]", text):
            i = m.start()
            if i < at:
                continue
            hit = next(((k, x.end()) for k, p in numbers if (x := p.match(text, i))), None)
            person = person_at(text, i) if not hit and unicodedata.category(text[i]) == "Lu" else None
            if hit:
                found.append((i, hit[1], None, [text[i : hit[1]]]))
                at = hit[1]
            elif person:
                found.append((i, person[0], person[2], person[1]))
                at = person[0]
        told = {}
        for _, _, gender, parts in found:
            if gender and gender != "n:":
                told.setdefault(parts[-1].split(" ")[-1].lower(), gender)
        for start, end, gender, parts in found:
            if gender:
                gender = told.get(parts[-1].split(" ")[-1].lower(), gender) if gender == "n:" else gender
                yield start, end, [("person" if k == len(parts) - 1 else "given", gender + p.split(" ")[-1].lower(), p) for k, p in enumerate(parts)]
            else:
                yield start, end, self.numbers(parts[0])

    def kind(self, mention):
        for kind, pattern in surrogates.KINDS:
            if regex.fullmatch(pattern, mention):
                digits = re.sub(r"\D", "", mention)
                bare = mention.replace(" ", "")
                if kind == "card" and len(digits) != 16 and not luhn(digits) or kind == "iban" and remainder_97(bare[4:] + bare[:4]) != 1:
                    return None
                return kind

    def numbers(self, mention):
        kind = self.kind(mention)
        digits = re.sub(r"\D", "", mention)
        entity = {"email": mention.lower(), "ip": mention, "ip6": mention.lower(), "iban": mention.replace(" ", ""), "phone": digits[1:] if len(digits) == 11 and digits[0] == "1" else digits}.get(kind, digits)
        return [(kind, entity if kind else None, mention)]

    def entities(self):
        return {(k, e) for _, _, found in self.rows for _, _, parts in found for k, e, _ in parts if k}

    def render(self, kind, entity, text, made):
        if kind is None:
            return text
        if kind in ("person", "given"):
            head, _, _ = text.rpartition(" ")
            old = text.split(" ")[-1]
            capitals = len(old) > 1 and old.upper() == old and not old.endswith(".")
            return (head + " " if head else "") + (made[2:].upper() if capitals else "-".join(p.capitalize() for p in made[2:].split("-")))
        if kind in ("ip", "ip6"):
            return made
        if kind == "email":
            return "".join(b.upper() if i < len(text) and "A" <= text[i] <= "Z" else b for i, b in enumerate(made))
        rest = iter(made)
        skip = len(re.sub(r"\D", "", text)) - len(made) if kind != "iban" else 0
        out = []
        for c in text:
            if kind == "iban" and c != " " or c in "0123456789" and skip <= 0:
                out.append(next(rest))
            else:
                skip -= c in "0123456789"
                out.append(c)
        return "".join(out)

    def texts(self, made):
        for d, text, found in self.rows:
            if text is None:
                yield d, None
                continue
            names, genitives = {}, {}
            for _, _, parts in found:
                for k, e, t in parts:
                    old = t.split(" ")[-1]
                    if k in ("person", "given") and not old.endswith("."):
                        new = self.render(k, e, old, made[k, e])
                        names.setdefault(old, new)
                        genitives.setdefault(old + "s", new + "s")
            gaps = [text[a:b] for a, b in zip([0, *[m[1] for m in found]], [*[m[0] for m in found], len(text)])]
            later = lambda m: names.get(m[0], genitives.get(m[0], m[0]))
            gaps = [regex.sub(r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+|['’](?!s(?!\p{L}))[\p{L}\p{M}]+)*", later, g) for g in gaps]
            out = []
            for gap, (_, _, parts) in zip(gaps, found):
                out += [gap, " ".join(self.render(k, e, t, made.get((k, e))) for k, e, t in parts)]
            yield d, "".join([*out, gaps[-1]])


def test_surrogates_against_brute_force(spark, documents):
    rng = random.Random(12)
    words = ["Mr.", "Mrs", "Herr", "Frau", "Dr.", "Prof.", "Dipl.-Ing.", "Dr. med.", "Professorin", "Mag.", "Bürgermeister", "President", "Господин", "Κυρία", "Παππάς", "Smiths", "MEIER", "Jones-Öz", "030/1234567", "(089) 1234567", "2001:DB8::1", "fe80:0:0:0:1:2:3:4", "a::b", "Smith", "Jones", "O'Brien", "Müller-Lüdenscheidt", "McDonald", "Иванов", "von", "der", "Anna", "J.", "and", "Smith's", "met", "+1 555 123 4567", "(555) 123-4567", "555-123-4567", "+49 30 1234 5678", "a.b@c.example.org", "A.B@c.Example.org", "4111 1111 1111 1111", "378282246310005", "378282246310006", "123-45-6789", "10.1.2.3", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE88 3704 0044 0532 0130 00", ",", ".", "ünd", "\n"]
    rows = [(i, "".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "")) for _ in range(rng.randrange(30)))) for i in range(900)]
    rows += [(1_000, "Mr. John Smith spoke. Smith left; the Smiths and Smith-Jones did not, nor did Smith's cat."), (1_001, None), (1_002, "")]
    rows += [(5_000 + r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    brute = Brute(rows)
    entities = spark.createDataFrame(sorted(brute.entities()), "kind string, entity string")
    made = {(r["kind"], r["entity"]): r["surrogate"] for r in surrogates.assign(entities, "k").collect()}
    assert len({(k, x) for (k, _), x in made.items()}) == len(made)
    found = replaced(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    for d, want in brute.texts(made):
        assert found[d]["text"] == want, (d, dict(rows)[d])
    one = found[1_000]["text"]
    name = re.match(r"Mr\. ([A-Z][a-z]+n) ([A-Z][a-z]+) spoke\. (.*)$", one)
    assert name[3] == f"{name[2]} left; the {name[2]}s and Smith-Jones did not, nor did {name[2]}'s cat."


def test_titles_stay_and_nothing_of_a_name(spark):
    texts = [
        "Herr Dr. Schmidt sah Frau Prof. Klein.",
        "Frau Dr. Anna Müller und Herr Müller",
        "Dr. Jane Doe, Prof. Max Weber and Dr. med. h. c. Karl von der Heide",
        "Mr. John Smith came. John stayed. Smiths came to John's.",
        "Herr Müller kam. Müllers Haus",
        "Mr. President! Mr. President Lincoln, Herr Bürgermeister MEIER",
        "Mrs. Jones-Öz",
        "Dr. Doe met Mrs. Doe. Doe left.",
        "Herr Adam Berta Cäsar Dora Emil Friedrich",
        "Mr. Παππάς, Господин Иванов",
        "Call 030/1234567, (089) 1234567 or 089 1234567; 2001:db8::1, not std::vector or 12:30:45",
    ]
    found = replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    new = [found[i]["text"] for i in range(len(texts))]
    n = r"([A-Z][a-z]+)"
    assert re.fullmatch(rf"Herr Dr\. {n} sah Frau Prof\. {n}\.", new[0])
    her = re.fullmatch(rf"Frau Dr\. [A-Z][a-z]*na {n} und Herr {n}", new[1])
    assert her[1] != her[2]
    assert re.fullmatch(rf"Dr\. {n} {n}, Prof\. {n} {n} and Dr\. med\. h\. c\. {n} von der {n}", new[2])
    assert re.fullmatch(r"Mr\. ([A-Z][a-z]+) ([A-Z][a-z]+) came\. \1 stayed\. \2s came to \1's\.", new[3])
    assert re.fullmatch(r"Herr ([A-Z][a-z]+) kam\. \1s Haus", new[4])
    assert re.fullmatch(rf"Mr\. President! Mr\. President {n}, Herr Bürgermeister [A-Z]+", new[5])
    assert re.fullmatch(rf"Mrs\. {n}-{n}", new[6])
    assert re.fullmatch(r"Dr\. ([A-Z][a-z]+) met Mrs\. \1\. \1 left\.", new[7])
    assert re.fullmatch(rf"Herr {n} {n} {n} {n} {n} {n}", new[8])
    assert re.fullmatch(r"Mr\. [Α-Ω][α-ως]+, Господин [А-Я][а-я]+", new[9])
    assert re.fullmatch(r"Call (0\d\d)/(\d{7}), \((0\d\d)\) (\d{7}) or \3 \4; 2[0-9a-f]{3}:[0-9a-f]{3}::[0-9a-f], not std::vector or 12:30:45", new[10])
    old = set(re.findall(r"[^\W\d_]{3,}", " ".join(texts[:10]))) - set("Herr sah Frau Prof und and med von der Mrs met left came stayed President Bürgermeister Господин kam Haus".split())
    assert not {w for w in old for t in new[:10] if re.search(rf"(?<!\w){w}(?!\w)", t)} - {"Smiths", "Müllers"} and "Smith" not in new[3] and "Müller" not in new[4]


def test_many_mentions_in_one_text(spark):
    text = " ".join(f"Mr. Given{chr(65 + i % 26)} Name{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]} spoke, Name{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}u left;" for i in range(20_000))
    out = replaced(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))[1]
    assert out["n_entities"] == 20_000 and not re.search("Given|Name", out["text"])


def test_account_numbers_keep_country_and_check_digits(spark):
    texts = [(1, "DE89 3704 0044 0532 0130 00 or DE89370400440532013000"), (2, "DE88 3704 0044 0532 0130 00")]
    found = replaced(spark.createDataFrame(texts, "doc_id bigint, text string"))
    one, two = found[1]["text"].split(" or ")
    assert one.replace(" ", "") == two != "DE89370400440532013000" and two.startswith("DE") and remainder_97(two[4:] + two[:4]) == 1 and len(one) == 27
    assert found[2]["text"] == texts[1][1] and found[2]["n_entities"] == 0


def test_columns_named_like_the_results_are_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a.b@c.example.org", "x", "y")], "doc_id bigint, text string, n_entities string, kinds string")
    out = surrogates.replace_pii(docs, key="k")
    assert out.columns == ["doc_id", "text", "n_entities", "kinds"]
    out.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["n_entities"] == 1


def test_the_key_decides(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    assert replaced(docs, "k") == replaced(docs.repartition(5), "k") and replaced(docs, "other")[4]["text"] != replaced(docs, "k")[4]["text"]


def test_surrogates_are_distinct_and_no_entities(spark):
    numbers = [f"{i:03d}-{i % 100:02d}-{i * 7919 % 10000:04d}" for i in range(3000)]
    entities = spark.createDataFrame([("ssn", re.sub(r"\D", "", n)) for n in numbers], "kind string, entity string").distinct()
    rows = surrogates.assign(entities, "k").collect()
    made = [r["surrogate"] for r in rows]
    assert len(rows) == entities.count() == len(set(made)) and not set(made) & {r["entity"] for r in rows}


def test_colliding_surrogates_try_again(spark):
    # numbers of two digits: nearly every first surrogate is another's, or an entity
    entities = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(40)], "kind string, entity string")
    rows = surrogates.assign(entities, "k").collect()
    assert len({r["surrogate"] for r in rows}) == 40 and not {r["surrogate"] for r in rows} & {r["entity"] for r in rows}


def test_surrogates_odd_documents(odd_documents, no_documents):
    out = surrogates.replace_pii(odd_documents, key="k")
    assert out.columns == [*odd_documents.columns, "n_entities", "kinds"]
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, odd_documents.select("doc_id", "text").collect()))
    assert surrogates.replace_pii(no_documents, key="k").count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_surrogates_query(spark, documents):
    out = queries.op3_pii_surrogates(spark, SF)
    both = out.join(documents.select("doc_id", F.col("text").alias("before")), "doc_id").collect()
    assert len(both) == documents.count()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    old = {m.lower() for r in both for m in mail.findall(r["before"] or "")}
    new = {m.lower() for r in both for m in mail.findall(r["text"] or "")}
    assert old and len(old) == len(new) and not old & new
    assert all(r["text"] == r["before"] for r in both if r["n_entities"] == 0)


# -- WARC

HTML = '<html lang="de"><head><title>Ein &amp; Titel</title><style>p{}</style></head><body><!-- no --><h1>Kopf</h1><p>Erster  Satz &lt;b&gt;.</p><script>x()</script><a href="/x">Ort</a><a class=y href=\'http://h/z\'>Z</a><a href="/x">Ort</a></body></html>'


def b32(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://h/a", HTML), (2, "http://h/b", None), (3, None, ""), (1, "http://h/a", HTML)], "page_id bigint, url string, html string").withColumn("block", F.lit("x"))
    source = {r["record_id"]: r for r in warc.responses(pages).collect()}
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 8 and len(source) == 3 and len({r["record_id"] for r in rows}) == 6
    for r in rows:
        of = source[r["refers_to"]]
        assert (r["target_uri"], r["date"], r["source_digest"]) == (of["target_uri"], of["date"], b32(of["payload"]))
        assert r["block_digest"] == b32(r["block"]) and r["content_length"] == len(r["block"].encode())
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-b[0-9a-f]{3}-[0-9a-f]{12}>", r["record_id"])
    own = {r["record_type"]: r["block"] for r in rows if r["page_id"] == 1}
    assert own["metadata"].split("\r\n") == ["title: Ein & Titel", "language: de", f"source-headers: HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: {len(HTML)}", "outlink: /x", "outlink: http://h/z"]
    assert own["conversion"].split("\n") == ["Ein & Titel", "Kopf", "Erster Satz <b>.", "OrtZOrt"]
    assert [r["block"] for r in rows if r["page_id"] == 3 and r["record_type"] == "conversion"] == [""]


def test_derivatives_decode_every_entity(spark):
    import html

    parts = ["Stra&szlig;e &amp; Pl&auml;tze", "&#8217;&#228;&#x41;", "&amp;auml; &amp;amp;", "&copy 2024 &rsquo;x&rsquo;", "R&D", "a&nbsp;b&#160;c", "plain"]
    made = [f"<html><title>{p}</title><body><p>{p}</p></body></html>" for p in parts]
    pages = spark.createDataFrame([(i, f"http://h/{i}", m) for i, m in enumerate(made)], "page_id bigint, url string, html string")
    for r in warc.derivatives(warc.responses(pages)).collect():
        text = html.unescape(parts[r["page_id"]]).replace("\u00a0", " ")
        assert r["block"] == f"{text}\n{text}" if r["record_type"] == "conversion" else r["block"].startswith(f"title: {text}\r\n")
        assert r["block_digest"] == b32(r["block"])


def test_record_layout(spark):
    pages = spark.createDataFrame([(1, "http://h/a", HTML)], "page_id bigint, url string, html string")
    for r in warc.derivatives(warc.responses(pages)).withColumn("record", warc.record_text()).collect():
        head, _, rest = r["record"].partition("\r\n\r\n")
        lines = head.split("\r\n")
        assert lines[0] == "WARC/1.1" and f"WARC-Refers-To: {r['refers_to']}" in lines and rest == r["block"] + "\r\n\r\n"


def squeezed(text):
    text = re.sub(r"[ \t\x0b\f\r]+", " ", text)
    return re.sub(r" ?\n[ \n]*", "\n", text).strip(" \n")


class Visible(HTMLParser):
    """Visible text as the standard library's parser tells it."""

    raw = ("script", "style", "noscript", "template")
    ends = "br p div li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav title".split()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [], None

    def handle_starttag(self, tag, attrs):
        if self.inside is None and tag in self.raw:
            self.inside = tag
        elif self.inside is None and tag in self.ends:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.inside:
            self.inside = None
            self.out.append(" ")
        elif self.inside is None and tag in self.ends and tag != "br":
            self.out.append("\n")

    def handle_comment(self, data):
        if self.inside is None:
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside is None:
            self.out.append(data)


def plain(made):
    parser = Visible()
    parser.feed(made)
    parser.close()
    return squeezed("".join(parser.out).replace("\u00a0", " "))


def test_visible_text_of_odd_markup(spark):
    rng = random.Random(8)
    parts = ["word", "1 < 2 and 3 > 2", " <3 ", "if a <= b", "<p>", "</p>", "<P class=x>", "<br/>", "<br >", "<b>", "</b>", "<a title=\"a > b\" href='/x?y=1'>", "</a>", "<!-- c > d -->", "<!---->", "<script>if (a < b) x('<p>')</script>", "<STYLE media=all>p > b {}</Style >", "<scripted>", "&lt;b&gt;", "&auml;", "R&D", "\n", "  ", "<!DOCTYPE html>", "<?x y?>", "<noscript>n <b>o</b></noscript>", "<img src=x alt='>'>", "<h2 id=k>", "</h2>", "<section>", "<div\n>", "é", "5<6"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) + rng.choice(["", "", "<script>never <p>closed"]) for _ in range(1500)]
    made += ["<p>1 < 2 and 3 > 2</p>", "a<script>b", "a <b title='x>y'>c</b>", "<p " + "a=b " * 20_000 + ">x", "<" * 10_000 + "x"]
    rows = {r["i"]: r["t"] for r in spark.createDataFrame(list(enumerate(made)), "i int, h string").select("i", warc.plain_text(F.col("h")).alias("t")).collect()}
    for i, m in enumerate(made):
        assert rows[i] == plain(m), m
    assert rows[1500] == "1 < 2 and 3 > 2" and rows[1501] == "a"
    # a comment that never ends is one to the end of the page
    assert spark.createDataFrame([("a<!-- b <p>c",)], "h string").select(warc.plain_text(F.col("h"))).first()[0] == "a"


def test_derivatives_against_brute_force(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    long_ = "<html><title>long</title>" + "<p>Ein Satz &amp; <a href='/q?a=1'>mehr</a>.\n  <!-- c -->" * 40_000
    pages = given.unionByName(spark.createDataFrame([(90_001, "http://h/long", long_)], "page_id bigint, url string, html string"))
    rows = {(r["page_id"], r["record_type"]): r for r in warc.derivatives(warc.responses(pages)).collect()}
    import html

    for p in pages.collect():
        made = p["html"] or ""
        text = rows[p["page_id"], "conversion"]["block"]
        assert text == plain(made) and rows[p["page_id"], "conversion"]["block_digest"] == b32(text)
        title = re.search(r"(?is)<title[^>]*>(.*?)</title", made)
        links = list(dict.fromkeys(re.findall(r"(?i)<a\s[^>]*?href=[\"']([^\"'>]*)", made)))
        fields = rows[p["page_id"], "metadata"]["block"].split("\r\n")
        assert fields[0] == "title: " + " ".join(plain(title[1] if title else "").split()) and fields[3:] == [f"outlink: {x}" for x in links]
        assert rows[p["page_id"], "metadata"]["source_digest"] == b32(made)


def test_values_cannot_begin_a_line(spark):
    url, html = "http://h/a\r\nWARC-Type: response\tx y", "<a href='/z\r\nx: y'>z</a>"
    pages = spark.createDataFrame([(1, url, html, "2026-01-02T03:04:05Z\r\nX: y", "HTTP/1.1 404 No\r\nX-Own: a b\r\n\r\n"), (2, "http://h/b", html, None, None)], "page_id bigint, url string, html string, date string, http_headers string")
    rows = {(r["page_id"], r["record_type"]): r for r in warc.derivatives(warc.responses(pages)).withColumn("record", warc.record_text()).collect()}
    one = rows[1, "metadata"]
    assert one["target_uri"] == "http://h/a%0D%0AWARC-Type:%20response%09x%20y" and one["date"] == "2026-01-02T03:04:05Z X: y"
    assert one["block"].split("\r\n")[2:] == ["source-headers: HTTP/1.1 404 No; X-Own: a b", "outlink: /z%0D%0Ax:%20y"]
    head = one["record"].partition("\r\n\r\n")[0]
    assert [line.split(":")[0] for line in head.split("\r\n")[1:]].count("WARC-Type") == 1
    assert rows[2, "metadata"]["date"] == warc.NO_DATE and "HTTP/1.1 200 OK" in rows[2, "metadata"]["block"]


def test_dates_of_captures_are_kept(spark):
    import datetime

    pages = spark.createDataFrame([(1, "u", "x", datetime.datetime(2026, 5, 4, 3, 2, 1))], "page_id bigint, url string, html string, date timestamp")
    assert warc.responses(pages).first()["date"] == "2026-05-04T03:02:01Z"


def test_files_read_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(70_001, "http://h/x", "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc äöü"), (70_002, None, None)], "page_id bigint, url string, html string")
    derived = warc.derivatives(warc.responses(pages.unionByName(odd)))
    warc.write_records(derived, str(tmp_path / "warc"), file_bytes=40_000)
    sizes = [f.stat().st_size for f in (tmp_path / "warc").glob("part-*")]
    assert len(sizes) > 3 and max(sizes) < 2 * 40_000
    read = warc.read_records(spark, str(tmp_path / "warc"))
    columns = ["record_type", "record_id", "refers_to", "target_uri", "date", "block_digest", "source_digest", "content_type", "block"]
    assert sorted(map(tuple, read.select(*columns).collect())) == sorted(map(tuple, derived.select(*columns).collect()))
    assert all(r["block_digest"] == b32(r["block"]) for r in read.collect())
    assert warc.read_records(spark, str(tmp_path / "warc")).groupBy("refers_to").count().where("count <> 2").isEmpty()


def test_cut_files_and_uris_of_other_letters(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/ä/日本", "<p>x"), (2, "http://h/b", "<p>yy")], "page_id bigint, url string, html string")
    warc.write_records(warc.derivatives(warc.responses(pages)), str(tmp_path / "warc"))
    assert {r["target_uri"] for r in warc.read_records(spark, str(tmp_path / "warc")).collect()} == {"http://h/ä/日本", "http://h/b"}
    data = b"".join(f.read_bytes() for f in (tmp_path / "warc").glob("part-*"))
    assert len(list(warc.parsed(data))) == 4
    for at in (len(data) - 1, len(data) - 30, 500, 12):
        with pytest.raises(ValueError):
            list(warc.parsed(data[:at]))
    with pytest.raises(ValueError):
        list(warc.parsed(b"x" + data))


def test_derivatives_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.derivatives(warc.responses(none)).count() == 0


def test_derivatives_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = queries.op5_warc_derivatives(spark, SF)
    assert found.count() == 2 * pages.count()
    assert found.groupBy("page_id").count().where("count <> 2").isEmpty()
