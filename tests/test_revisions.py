"""Revisions: the rules one by one, table and stream against a fold by hand, replayed batches, timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberline.streaming import revisions

T0 = dt.datetime(2024, 1, 1)


def event(incident, second, ordinal, kind, evidence=None, expected=None, decision=None, selected=None, request=None):
    return incident, T0 + dt.timedelta(seconds=second), ordinal, kind, evidence, expected, decision, selected, request


def by_hand(events):
    heads, known, out = {}, {}, []
    for e in sorted(events, key=lambda e: (e[0] or "", e[1], e[2])):
        seen = known.setdefault(e[0], set())
        heads[e[0]], outcome, reason = revisions.step(heads.get(e[0], revisions.Head()), e[4] in seen, e[3], *e[5:])
        if e[3] == "evidence":
            seen.add(e[4])
        out.append((e[0], e[2], e[3], heads[e[0]].revision, outcome, reason))
    return out


RULES = [
    event("i", 1, 1, "decision", expected=1, decision="approved", selected="1"), event("i", 2, 2, "evidence", "a"), event("i", 3, 3, "evidence", "a"), event("i", 4, 4, "evidence", "b"),
    event("i", 5, 5, "decision", expected=2, decision="rejected"), event("i", 6, 6, "decision", expected=1, decision="approved"), event("i", 7, 7, "decision", expected=1, decision="maybe"),
    event("i", 8, 8, "decision", expected=1, decision="approved", selected="1", request="r"), event("i", 9, 9, "decision", expected=1, decision="approved", selected="1", request="r"),
    event("i", 10, 10, "decision", expected=1, decision="rejected"), event("i", 11, 11, "evidence", "b"), event("i", 12, 12, "evidence", "late"), event("i", 13, 13, "decision", expected=1, decision="rejected"),
    event("i", 14, 14, "decision", expected=2, decision="request_more_evidence"), event("i", 15, 15, "evidence", "more"), event("i", 16, 16, "decision", decision="rejected"),
]


def test_rules():
    assert [(r[3], r[4], r[5]) for r in by_hand(RULES)] == [
        (0, "refused", "no_revision"), (1, "opened", "first_evidence"), (1, "duplicate", None), (1, "added", None), (1, "refused", "stale_revision"), (1, "refused", "no_selection"),
        (1, "refused", "invalid_decision"), (1, "decided", None), (1, "repeated", None), (1, "refused", "already_decided"), (1, "duplicate", None), (2, "opened", "late_evidence"),
        (2, "refused", "stale_revision"), (2, "decided", None), (3, "opened", "requested_evidence"), (3, "refused", "stale_revision"),
    ]


def many(n, seed=3):
    rng = random.Random(seed)
    kinds = lambda i: event(f"n{rng.randrange(5)}", i, i, "evidence", f"e{rng.randrange(60)}") if rng.random() < 0.7 else event(
        f"n{rng.randrange(5)}", i, i, "decision", expected=rng.randrange(1, 5), decision=rng.choice(["approved", "rejected", "request_more_evidence"]), selected=rng.choice([None, "1"]))
    return [kinds(i) for i in range(n)]


def test_table(spark):
    events = [*RULES, *many(300), event(None, 1, 500, "evidence", None)]
    found = revisions.replayed(spark.createDataFrame(events, revisions.EVENT).repartition(7))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(by_hand(events), key=str)
    assert revisions.replayed(spark.createDataFrame([], revisions.EVENT)).count() == 0


@pytest.fixture()
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def test_stream(spark, tmp_path, state_store):
    """Three files, one a batch: the same outcomes as the table; a replayed batch changes nothing; a run without new files neither; a late record opens a revision."""
    events = [*RULES, *many(300)]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    ordered = sorted(events, key=lambda e: (e[1], e[2]))
    add = lambda rows: spark.createDataFrame(rows, revisions.EVENT).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(revisions.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        revisions.committed(revisions.revision_stream(stream, "10 minutes", 60), out, checkpoint).awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(out).drop("batch").collect()), key=str)

    for i in range(0, len(ordered), 120):
        add(ordered[i : i + 120])
        found = run()
    steps = [r for r in found if r[2] != "timer"]
    assert steps == sorted(by_hand(events), key=str)
    assert run() == found
    first = spark.read.parquet(f"{out}/batch=0")
    rows = first.collect()
    revisions.commit_batch(out, spark.createDataFrame(rows, first.schema), 0)
    assert sorted((tuple(r) for r in spark.read.parquet(out).drop("batch").collect()), key=str) == found
    # The incident was decided (revision 3 is open): decide it, then evidence of an old time opens revision 4; time moves on and says that it is ready.
    add([event("i", 400, 600, "decision", expected=3, decision="rejected")])
    add([event("i", 1, 601, "evidence", "very late")])
    add([event("other", 5000, 602, "evidence", "x")])
    after = {r[1]: r for r in run() if r[0] == "i"}
    assert after[600][3:] == (3, "decided", None) and after[601][3:] == (4, "opened", "late_evidence")
    assert ("i", None, "timer", 4, "ready", None) in run()
