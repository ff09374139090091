import pytest

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"

#: Columns whose names operators use inside.
CLASHING = ("c0", "c1", "node", "loose", "block", "spans", "items", "base", "ids", "lang_pred", "score", "mixture", "chunk", "_key", "_found", "doc", "k", "id")


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): nulls, empty, no words, one word, ties, repeated rows, one very long text."""
    words = [f"wort{i % 97}x{i % 13}" for i in range(60_000)]
    near = [f"n{i}" for i in range(80)]
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "one"),
        (5, "one"),
        (5, "one"),
        (6, " ".join(near)),
        (7, " ".join([*near[:40], "changed", *near[41:]])),
        (8, " ".join(near) + "\n"),
        (9, " ".join(words)),
        (10, " ".join(words)),
        (11, "…" * 50 + " 日本語のテキスト ÄÖÜ"),
        (None, "a text under no id"),
        (None, None),
        (-12, "negative id " + " ".join(near)),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    df = spark.createDataFrame(odd_texts, "doc_id bigint, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({name: F.lit(name) for name in CLASHING})


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
