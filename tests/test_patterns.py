"""Ordered patterns against a search in each trace."""

import random

import pytest

from emberline.operators import patterns
from emberline.operators.patterns import Step

ROWS = "trace string, position long, event string"


def holds(events, steps):
    """Whether the steps can be placed, by trying all places."""

    def place(k, after):
        if k == len(steps):
            return True
        near = [after + 1] if steps[k].next and k else range(after + 1, len(events))
        return any(i < len(events) and events[i] in steps[k].events and place(k + 1, i) for i in near)

    return place(0, -1)


CASES = [
    [Step(frozenset("a"))], [Step(frozenset("a")), Step(frozenset("b"))], [Step(frozenset("a")), Step(frozenset("b"), True)], [Step(frozenset("a")), Step(frozenset("a"), True), Step(frozenset("b"))],
    [Step(frozenset("ab")), Step(frozenset("bc"), True), Step(frozenset("c")), Step(frozenset("a"), True)], [Step(frozenset())], [Step(frozenset("a"), True), Step(frozenset("z"))],
]


@pytest.fixture(scope="module")
def traces():
    rng = random.Random(11)
    found = {f"t{i}": [rng.choice("abcd") for _ in range(rng.randrange(1, 12))] for i in range(40)}
    found["long"] = [rng.choice("dc") for _ in range(700)] + ["a", "d", "b"]
    found[None] = ["a", None, "b"]
    return found


@pytest.mark.parametrize("steps", CASES)
def test_matches_a_search(spark, traces, steps):
    """Short and long traces, a null trace, null events, steps without events; chunks of any size give the same."""
    rows = [(t, i * 3 - 5, e) for t, events in traces.items() for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    expected = {t: (len(e), holds(e, steps)) for t, e in traces.items()}
    for chunk in (4, 64, patterns.CHUNK):
        assert {r["trace"]: (r["events"], r["matched"]) for r in patterns.matched(df, steps, chunk).collect()} == expected


def test_bounds(spark):
    df = spark.createDataFrame([], ROWS)
    assert patterns.matched(df, CASES[0]).count() == 0 and patterns.after_last(df, ["a"]).count() == 0
    with pytest.raises(ValueError):
        patterns.compiled([])
    tied = spark.createDataFrame([("t", 1, "b"), ("t", 1, "a"), ("t", 1, None), ("t", 1, "a")], ROWS)  # in the order null, a, a, b
    assert patterns.matched(tied, CASES[2]).first()["matched"] and not patterns.matched(tied, [Step(frozenset("b")), Step(frozenset("a"))]).first()["matched"]


def test_after_last(spark, traces):
    rows = [(t, i, e) for t, events in traces.items() for i, e in enumerate(events)] + [("m", 0, "a"), ("m", 1, None)]
    expected = {}
    for t, events in [*traces.items(), ("m", ["a", None])]:
        if at := [i for i, e in enumerate(events) if e in ("a", "b")]:
            rest = events[at[-1] + 1 :]
            expected[t] = (events[at[-1]], rest[0] if rest else None, not rest)
    for chunk in (1, 3, patterns.CHUNK):
        found = {r["trace"]: tuple(r)[1:] for r in patterns.after_last(spark.createDataFrame(rows, ROWS).repartition(3), ["a", "b"], chunk).collect()}
        assert found == expected
    truth = spark.createDataFrame([(t, i % 2) for i, t in enumerate(sorted(t for t in traces if t))], "trace string, label int")
    top = patterns.follow_ups(patterns.after_last(spark.createDataFrame(rows, ROWS), ["a", "b"]), truth, keep=2).collect()
    assert max(r["rank"] for r in top) == 2 and all(r["traces"] > 0 for r in top)
