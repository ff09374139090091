"""The bitmap index against the operators that read the rows."""

import random
import re

from pyspark.sql import functions as F

from agoralake.operators import facet_index, facets


def test_index_and_rows_agree(spark, tmp_path):
    rng = random.Random(6)
    ids = [*range(-3, 40), *range(32760, 32800), 65535, 65536, 1 << 40, -(1 << 40), None]
    rows = [(i, rng.choice(["a", "b", None, ""]), rng.choices(["x", "y", "z", None], k=rng.randint(0, 3)), rng.randint(1, 4)) for i in ids]
    df = spark.createDataFrame(rows, "id bigint, one string, many array<string>, size int")
    facet_index.write_index(facet_index.build(df, ["one", "many", "size"], "id"), str(tmp_path / "index"))
    index, known = facet_index.read_index(spark, str(tmp_path / "index")), df.where("id is not null")
    for chosen in ({}, {"one": ["a", "b"]}, {"one": [""], "many": []}, {"one": ["a", "b", ""], "many": ["x", "z"], "size": [1, 2, 3]}, {"many": ["none"]}, {"one": ["a"], "size": [9]}):
        want = facets.select(known, chosen)
        assert sorted(r["id"] for r in facet_index.ids(facet_index.select(index, chosen)).collect()) == sorted(r["id"] for r in want.collect())
        assert tuple(facet_index.hits(index, chosen).first()) == (want.count(), known.count())
        assert facet_index.message(index, chosen).first() == facets.message(known, chosen).first()
        within = lambda d: sorted(map(tuple, d.collect()))
        assert within(facet_index.counts_within(index, ["one", "many"], chosen)) == within(facets.counts(want, ["one", "many"]))
    assert sorted(map(tuple, facet_index.counts(index, ["one", "many", "size"]).collect())) == sorted(map(tuple, facets.counts(known, ["one", "many", "size"]).collect()))
    assert sorted(map(tuple, facet_index.cardinalities(index, ["one", "size", "gone"]).collect())) == [("gone", 0), ("one", 3), ("size", 4)]
    assert facet_index.build(df.limit(0), ["one"], "id").count() == 0
    plan = facet_index.hits(index, {"one": ["a"]})._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("PartitionFilters: \\[[^]]*axis", plan)) == 2


def test_no_rows(spark):
    index = facet_index.build(spark.createDataFrame([], "id bigint, one string"), ["one"], "id")
    assert tuple(facet_index.hits(index, {"one": ["a"]}).first()) == (0, 0) and facet_index.ids(facet_index.select(index, {})).count() == 0
    assert facet_index.message(index, {}).select(F.col("line").startswith("0 ")).first()[0]
