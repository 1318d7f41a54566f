"""Verification within a budget: what passes, what goes, how often the verifier is asked."""

import pytest
from pyspark.sql import functions as F

from timelens.operators import verify


@pytest.fixture
def setting(spark):
    calls = spark.sparkContext.accumulator(0)

    def verifier(frames):
        def look(batches):
            for df in batches:
                calls.add(len(df))
                yield df.assign(accepted=[None if a == "unreadable" else a == "yes" for a in df["truth"]])

        return frames.mapInPandas(look, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema) + ", accepted boolean")

    return calls, verifier


def run(spark, setting, truths, **more):
    calls, verifier = setting
    calls.value = 0
    rows = [(c, i, 1.0 - i / 100, t) for c, ts in truths.items() for i, t in enumerate(ts)]
    hits = spark.createDataFrame(rows, "claim string, id int, score double, truth string")
    got = verify.verify_hits(hits, "claim", verifier, ["id"], **more).collect()
    return sorted((r["claim"], r["id"], r["checked"]) for r in got), calls.value


def test_stops_after_accepts(spark, setting):
    got, calls = run(spark, setting, {"a": ["yes", "no", "no", "no"]}, accepts=1)
    assert got == [("a", 0, True), ("a", 1, False), ("a", 2, False), ("a", 3, False)] and calls == 1
    got, calls = run(spark, setting, {"a": ["no", "no", "yes", "no", "no"]}, accepts=1)
    assert got == [("a", 2, True), ("a", 3, False), ("a", 4, False)] and calls == 3
    got, calls = run(spark, setting, {"a": ["no"] * 5}, accepts=1)
    assert got == [] and calls == 5


def test_answers_past_the_end_do_not_count(spark, setting):
    # the third batch looks at four, of which the first ends the search
    got, calls = run(spark, setting, {"a": ["no", "no", "no", "yes", "no", "no", "no"]}, accepts=1)
    assert got == [("a", 3, True), ("a", 4, False), ("a", 5, False), ("a", 6, False)] and calls == 7
    assert run(spark, setting, {"a": ["no", "no", "no", "yes", "no", "no", "no"]}, accepts=1, growth=1) == (got, 4)


def test_checks_are_bounded_by_claim(spark, setting):
    got, calls = run(spark, setting, {"a": ["no"] * 30, "b": ["yes"] * 3})
    assert got == [("a", i, False) for i in range(16, 30)] + [("b", i, True) for i in range(3)] and calls == 19


def test_unreadable_frames_and_weak_hits_pass(spark, setting):
    got, calls = run(spark, setting, {"a": ["unreadable", "no", "unreadable", "no", "no", "no"]}, checks=3, floor=0.96)
    assert got == [("a", 0, False), ("a", 2, False), ("a", 5, False)] and calls == 5
    got, calls = run(spark, setting, {"a": ["unreadable"] * 20 + ["no", "no"]}, checks=1)
    assert got == [("a", i, False) for i in range(20)] + [("a", 21, False)]


def test_no_hits(spark, setting):
    hits = spark.createDataFrame([("a", 1, 0.05, "no")], "claim string, id int, score double, truth string")
    assert verify.verify_hits(hits, "claim", setting[1], ["id"]).count() == 1 and verify.verify_hits(hits.limit(0), "claim", setting[1], ["id"]).count() == 0
    assert setting[0].value == 0


def test_repeated_rows(spark, setting):
    hits = spark.createDataFrame([("a", 1, 0.5, "no")] * 3 + [("a", 2, 0.4, "yes")] * 2, "claim string, id int, score double, truth string")
    assert verify.verify_hits(hits, "claim", setting[1], ["id"], checks=4).filter(F.col("truth") == "yes").count() == 2
