"""Keyed state over several batches, with a restart between any two of them."""

import pytest

from agoralake.streaming import arrivals

ROWS = "ref string, title string, arrived bigint"
BATCHES = [[("a", "alt", 1), ("b", "spät", 9), ("b", "früh", 2), (None, "ohne", 1)], [("a", "neu", 0), ("c", "c", 3)], [("b", "noch", 1), ("d", "zwei", 4), ("d", "eins", 4), ("c", "c", 3)]]


@pytest.fixture
def folders(tmp_path):
    return {name: str(tmp_path / name) for name in ("in", "sessions", "minutes", "out", "checkpoint")}


def test_the_first_row_of_a_key_stays_over_batches_and_restarts(spark, folders):
    seen = []
    for rows in [*BATCHES, BATCHES[0]]:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(folders["in"])
        stream = arrivals.first_arrivals(spark.readStream.schema(ROWS).json(folders["in"]))
        arrivals.append_to(stream, folders["out"], folders["checkpoint"]).awaitTermination()
        seen.append(sorted(tuple(r) for r in spark.read.parquet(folders["out"]).collect()))
    first = [("a", "alt", 1), ("b", "früh", 2)]
    assert seen == [first, sorted([*first, ("c", "c", 3)]), (last := sorted([*first, ("c", "c", 3), ("d", "eins", 4)])), last]


def test_minutes_reach_their_session_in_either_order(spark, folders):
    batches = [([("s1",), ("s2",)], [("s3", "m3", 5)]), ([("s3",)], [("s1", "m1b", 8), ("s1", "m1a", 7)]), ([("s1",), ("s4",)], [("s1", "m1c", 1), ("s2", None, 1), ("s9", "m9", 1)])]
    seen = []
    for sessions, minutes in batches:
        spark.createDataFrame(sessions, "session_url string").coalesce(1).write.mode("append").json(folders["sessions"])
        spark.createDataFrame(minutes, "session_url string, minutes_url string, order bigint").coalesce(1).write.mode("append").json(folders["minutes"])
        read = lambda name, schema: spark.readStream.schema(schema).json(folders[name])
        stream = arrivals.late_minutes(read("sessions", "session_url string"), read("minutes", "session_url string, minutes_url string, order bigint"))
        arrivals.append_to(stream, folders["out"], folders["checkpoint"]).awaitTermination()
        seen.append(sorted(tuple(r) for r in spark.read.parquet(folders["out"]).collect()))
    assert seen == [[], [("s1", "m1a"), ("s3", "m3")], [("s1", "m1a"), ("s3", "m3")]]
