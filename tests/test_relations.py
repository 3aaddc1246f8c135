"""Relations without rejected pairs against all pairs; one ranking of all kinds of candidates on small cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import correlation, ranking

SIDE = "incident string, event_id string, first_seen timestamp, last_seen timestamp, execution_ids array<string>, workload_ids array<string>, hosts array<string>, pods array<string>"


def side(rng, n, name):
    some = lambda kind, most: rng.choice([None, [], *[[f"{kind}{rng.randrange(most)}" for _ in range(rng.randrange(1, 3))] for _ in range(3)]])
    rows = []
    for i in range(n):
        start = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60))
        rows.append((rng.choice("ab"), f"{name}{i}", rng.choice([start, start, start, None]), start + dt.timedelta(minutes=rng.randrange(30)), some("x", 4), some("w", 6), some("h", 6), some("x", 9)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_summary_equals_all_pairs(spark, seed):
    """Shared ids of several kinds, ids of one name but two kinds, missing times and ids, conflicts; an incident whose groups all miss or all come before."""
    rng = random.Random(seed)
    signals = spark.createDataFrame([*side(rng, 40, "s"), ("late", "z", dt.datetime(2024, 2, 2), dt.datetime(2024, 2, 3), ["q"], None, ["h1"], None), ("nobody", "y", None, None, None, None, None, None)], SIDE)
    lifecycles = spark.createDataFrame([(*r, rng.choice(["failed", "succeeded", "started", "odd", None])) for r in [*side(rng, 40, "l"), ("late", "k", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), ["p"], None, ["h2"], None)]], SIDE + ", status string")
    pairs = correlation.lifecycle_relations(signals, lifecycles)
    columns = ["event_id", "l_event_id", "entity_match", "time_relation", "outcome_role", "confidence"]
    expected = sorted(map(tuple, pairs.filter("accepted").select(columns).collect()))
    assert sorted(map(tuple, correlation.accepted_relations(signals, lifecycles).select(columns).collect())) == expected and expected
    has = lambda role: F.coalesce(F.bool_or(F.col("accepted") & (F.col("outcome_role") == role)), F.lit(False))
    whole = pairs.groupBy("incident", "event_id").agg(
        has("adverse"), has("recovery"), has("successful_completion"), F.count_if("accepted"), F.count_if(~F.col("accepted")),
        F.bool_and(F.col("entity_match") == "mismatch"), F.bool_and(F.col("time_relation") == "before"),
    )
    found = correlation.relation_summary(signals, lifecycles)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    late = found.filter("incident = 'late'").first()
    assert late["all_miss"] and late["all_before"] and found.filter("incident = 'nobody'").count() == 0
    assert correlation.relation_summary(signals.limit(0), lifecycles).count() == 0 and correlation.relation_summary(signals, lifecycles.limit(0)).count() == 0


ROW = "incident string, kind int, place long, candidate_id string, event_key string, category string, score int, reasons array<string>, weaknesses array<string>"
CONTEXT = "incident string, failed_sources array<string>, contradicted boolean, observations long, eligible long, observed_categories array<string>"


def test_one_ranking(spark):
    rows = [
        ("a", 0, 5, "d1", "e1", "config", 70, ["r1"], []), ("a", 2, 0, "dep", "e1", "dependency", 42, ["r2", "r1"], ["w1"]), ("a", 3, 0, "t", "t|t", "traffic", 55, ["r3"], ["w2"]), ("a", 0, 6, "d2", "e2", "oom", 55, ["r1"], []),
        ("a", 0, 7, "d3", "e3", "x", 10, ["r1"], []), ("b", 1, 0, "s", "e9", "disk", 90, ["r"], []), ("tie", 3, 0, "t", "k1", "c", 50, ["r"], []), ("tie", 0, 0, "u", "k2", "c", 50, ["r"], []),
    ]
    context = [("a", [], True, 3, 1, ["x"]), ("b", ["metrics", "logs"], False, 1, 1, ["x", "y"]), ("tie", [], False, 0, 0, []), ("none", [], True, 2, 0, [])]
    found = ranking.ranked(spark.createDataFrame(rows, ROW), spark.createDataFrame(context, CONTEXT)).orderBy("incident", "rank").collect()
    a = [r for r in found if r["incident"] == "a"]
    assert [(r["candidate_id"], r["score"], r["rank"], r["label"]) for r in a] == [("d1", 70, 1, "high"), ("d2", 55, 2, "medium"), ("t", 55, 3, "medium")]
    assert a[0]["categories"] == ["config", "dependency"] and a[0]["reasons"] == ["r1", "r2"] and a[0]["weaknesses"] == ["w1", ranking.CONFLICT] and a[2]["weaknesses"] == ["w2", ranking.CONFLICT]
    assert all((r["top_gap"], r["abstain"], r["expansion_recommended"], r["expansion_reason"]) == (15, False, False, ranking.EXPANSION[2]) for r in a)
    b, none, tie, _ = [r for r in found if r["incident"] != "a"]
    assert (b["score"], b["label"], b["weaknesses"], b["abstain"], b["top_gap"]) == (60, "medium", ["Missing source data: metrics, logs"], True, None)
    assert len(b["abstain_reasons"]) == 2 and b["expansion_reason"] == ranking.EXPANSION[0]
    assert (none["rank"], none["candidate_id"], none["weaknesses"], none["expansion_reason"]) == (None, None, None, ranking.EXPANSION[1]) and len(none["abstain_reasons"]) == 2
    assert (tie["candidate_id"], tie["top_gap"], tie["abstain"]) == ("u", 0, True)
    assert ranking.ranked(spark.createDataFrame(rows, ROW), spark.createDataFrame([], CONTEXT)).count() == 0
