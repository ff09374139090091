"""Many patterns in one pass, against Python's re."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agoralake.functions import keywords, rules
from tests.oracle import compare, connection

TABLE = rules.LIFE_SITUATIONS + rules.OCCASIONS


def labels(text, table=TABLE):
    return list(dict.fromkeys(label for p, label in table if re.search(p, text or "", re.I)))


def words():
    """Keywords of all rules, spelled out, and what makes them match or not."""
    out = []
    for pattern in [p for p, _ in TABLE] + list(rules.ROUTINE):
        for a in keywords.alternatives(pattern):
            plain = re.sub(r"\\[bsdw]|[\\^$]|\[[^]]*\](?:\{[^}]*\})?|\{[^}]*\}", "", a)
            out.append(re.sub(r"\(([^|()]*)\|?[^()]*\)", r"\1", plain).replace(".*", " neue ").replace("?", "").replace("+", ""))
    return out


def test_labels_of_random_texts():
    rng = random.Random(2)
    pool = words() + ["ÖPNV", "öpnv", "OEPNV", "ſchule", "SCHULE", "STRASSE", "Straße", "STRAẞE", "\u212aita", "KİTA", "kıta", "bank", "Bankett", "see", "Seele", "bad", "Badß", "äbad", "bb 16", "b16", "B 16", "30er", "30-er", "str.", "strx", "_bus", "bus1", "der", "und", "x"]
    scan = keywords.scanner(tuple(p for p, _ in TABLE))
    routine = keywords.scanner(rules.ROUTINE)
    seen, usual = set(), set()
    for _ in range(6000):
        picked = rng.choices(pool, k=rng.choice((1, 1, 2, 3, 4)))
        text = rng.choice(["", " ", "-", "\n", "ä"]).join(w if rng.random() < 0.6 else rng.choice([w.upper(), w.title(), w[: rng.randint(0, len(w))], w + rng.choice("s.ä1_ ")]) for w in picked)
        assert list(dict.fromkeys(TABLE[k][1] for k in sorted(scan(text)))) == labels(text), text
        assert routine(text) == {k for k, p in enumerate(rules.ROUTINE) if re.search(p, text, re.I)}, text
        seen |= scan(text)
        usual |= routine(text)
    assert len(seen) == 25 and len(usual) > 30


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="kitaschulbnd seürß|.-KİſK\n16", max_size=40))
def test_any_text(text):
    scan = keywords.scanner(tuple(p for p, _ in TABLE))
    assert [TABLE[k][1] for k in sorted(scan(text))] == [label for p, label in TABLE if re.search(p, text, re.I)]


@pytest.mark.parametrize(
    ("pattern", "parts", "fixed"),
    [("a|b(c|d)|[|x]e", ["a", "b(c|d)", "[|x]e"], ["a", "b", "e"]), (r"\bb ?16\b", [r"\bb ?16\b"], ["16"]), (r"Mit+eilungen\b.{0,60}(Stadt)", [r"Mit+eilungen\b.{0,60}(Stadt)"], ["eilungen"]), (r"str\.", [r"str\."], ["str."]), ("x?y*", ["x?y*"], [""]), (r"[\]a]b(c[)]d|e)fg", [r"[\]a]b(c[)]d|e)fg"], ["fg"]), ("[^]x]yy[^a]z", ["[^]x]yy[^a]z"], ["yy"]), ("30-?er", ["30-?er"], ["30"])],
)
def test_parts_of_patterns(pattern, parts, fixed):
    assert keywords.alternatives(pattern) == parts and [keywords.fixed_part(p) for p in parts] == fixed


def test_columns(spark):
    texts = ["Neue Kita und Schule an der B 16", None, "", "Eröffnung der Sitzung", "nichts", "ABWASSER\nPflege"] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", rules.tags(F.col("t"), TABLE).alias("tags"), rules.is_routine(F.col("t")).alias("routine")).collect()
    assert all(r["tags"] == labels(texts[r["i"]]) and r["routine"] == any(re.search(p, texts[r["i"]] or "", re.I) for p in rules.ROUTINE) for r in rows)


def test_sql_of_every_rule(spark, tmp_path):
    """The SQL holds word bounds of all scripts: each rule on texts that match and on texts that nearly do."""
    from agoralake.plans.catalogue import QUERIES
    from agoralake.plans.oracle import ORACLE_SQL

    rng = random.Random(4)
    pool = [w for w in words() if w.strip()] + ["äbad", "bad", "badä", "_bus", "bus", "7see", "see", "Bank", "Bänke", "pflegeö", "pflege", "THI", "thié"]
    rows = [(i, rng.choice([" ", "", ", "]).join(rng.choices(pool, k=3)), "de", "src") for i in range(800)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = connection("/root/testdata/sf0.001")
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["multi_label_tags"](spark, str(tmp_path))
    assert found.select("tag").distinct().count() == len(dict(map(reversed, TABLE)))
    assert compare(found, con, ORACLE_SQL["multi_label_tags"]) == ""
