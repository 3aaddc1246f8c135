"""The similarity join against all pairs; shapes, coverage and quantiles on small cases."""

import random
import statistics as plain
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import similarity, statistics


def by_library(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@settings(max_examples=200, deadline=None)
@given(st.text("abc é😀", max_size=25), st.text("abc é😀", max_size=25))
def test_ratio_equals_the_library(a, b):
    assert similarity.matching_ratio(a, b) == by_library(a, b)


def messages(n, seed):
    rng = random.Random(seed)
    base = ["connection to %d refused by peer %d", "disk full on /dev/sd%d", "user %d logged in from %d", "x" * 30 + "%d", "%d"]
    some = [rng.choice(base).replace("%d", "{}").format(*[rng.randrange(10 ** rng.randrange(1, 5)) for _ in range(2)]) + rng.choice(["", " again", " " * 3, " and more words to it"]) for _ in range(n)]
    return [*some, "", "", None, "é" * 40, "É" * 39 + "x", "w" * 500, "w" * 181, "w" * 190]


def test_join_equals_all_pairs(spark):
    """Ties, equal and empty texts, null block values, lengths at the bound; few pairs are compared."""
    rows = [(f"g{i:03d}", i, ("a", "b", None)[i % 3], m) for i, m in enumerate(messages(120, 4))]
    df = spark.createDataFrame(rows, "event_id string, ordinal long, service string, m string")
    expected = set()
    for i, o, block, m in rows:
        scored = [(by_library((m or "").lower(), (n or "").lower()), j) for j, p, other, n in rows if p > o and other == block]
        good = [x for x in scored if x[0] >= similarity.NEAR]
        if good:
            expected.add((i, max(good)[1], round(max(good)[0], 6)))
    found = similarity.near_pairs(df.repartition(4), ["service"], "m")
    assert {(r["left_id"], r["right_id"], r["ratio"]) for r in found.collect()} == expected
    texts = df.select("service", F.col("event_id").alias("id"), "ordinal", F.lower(F.coalesce("m", F.lit(""))).alias("text"))
    met, every = similarity.candidate_pairs(texts, ["service"]).count(), 3 * 42 * 41 // 2
    alike = sum(1 for i, o, b, m in rows for j, p, c, n in rows if p > o and b == c and by_library((m or "").lower(), (n or "").lower()) >= similarity.NEAR)
    assert alike <= met < 0.75 * every
    assert similarity.near_pairs(df.limit(0), ["service"], "m").count() == 0


def test_variants(spark):
    rows = [("g", 5, "one A"), ("g", 1, "ONE b"), ("g", 9, "one A"), ("g", 7, "three"), ("h", 2, "same"), ("h", 3, "same"), ("n", 1, None), ("n", 2, "x")]
    found = {r["k"]: (r["left_id"], r["right_id"], r["ratio"]) for r in similarity.variant_pairs(spark.createDataFrame(rows, "k string, id long, message string"), ["k"]).collect()}
    assert found == {"g": ("1", "7", round(by_library("one b", "three"), 6)), "n": ("1", "2", 0.0)}


def test_sampling_shapes(spark):
    cases = {
        "Took -12.5 ms HTTP 503": "took -<num> ms http_status=503", "id 123e4567-e89b-12d3-a456-426614174000 x": "id <uuid> x", "Mon Jan 01 10:00:00 2024 up": "mon jan <num> <num>:<num>:<num> <num> up",
        "blk_[ID] blk_[ID]": "blk_[id] blk_[id]", "peer=10.0.0.1  commit abcdef1": "peer=? commit <hex>", None: "", "x" * 200: "x" * 120 + " … " + "x" * 56,
    }
    df = spark.createDataFrame([(i, m) for i, m in enumerate(cases)], "id int, m string")
    found = [r[0].split("\x1f") for r in df.select("id", text.sampling_shape(F.col("m"), [F.lit("Svc"), F.lit(None)], F.lit("WARN")).alias("s")).orderBy("id").select("s").collect()]
    assert [f[:3] for f in found] == [["Svc", "warn", ""]] * len(cases) and [f[3] for f in found] == list(cases.values())


def test_coverage(spark):
    rows = [("c", "common", i == 0, False) for i in range(11)] + [("c", "rare", False, True), ("c", "loud", True, False), ("c", "loud", False, True), ("d", "x", True, True), ("d", None, False, None)]
    found = {r["case"]: r for r in statistics.label_coverage(spark.createDataFrame(rows, "case string, label string, sampled boolean, high_signal boolean")).collect()}
    c, d = found["c"], found["d"]
    assert (c["labels"], c["sampled_labels"], c["high_signal_labels"], c["sampled_high_signal"], c["rare_labels"], c["sampled_rare"], c["rows"]) == (3, 2, 2, 0, 2, 1, 14)
    assert (c["coverage"], c["high_signal_coverage"], c["rare_coverage"], d["coverage"], d["high_signal_coverage"]) == (0.6667, 0.0, 0.5, 0.5, 1.0)


def test_quantiles_and_no_cross_join(spark):
    values = [3.0, 1.0, 1.0, 9.0, 4.0, 1.0, None]
    df = spark.createDataFrame([("k", v) for v in values] + [("one", 2.0)], "key string, v double")
    found = {r["key"]: r["quantile"] for r in statistics.interpolated(df, ["key"], "v", 0.95).collect()}
    assert abs(found["k"] - plain.quantiles([v for v in values if v is not None], n=100, method="inclusive")[94]) < 1e-9 and found["one"] == 2.0
    rows = spark.createDataFrame([(1, "g", "a"), (2, "g", "b")], "ordinal long, predicted string, label string")
    grouped = statistics.pairwise_grouping(rows.select("ordinal", F.lit("all").alias("case"), "predicted"), rows.select("ordinal", "label"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert (grouped.first()["tp"], grouped.first()["fp"], grouped.first()["rows"], grouped.first()["labels"]) == (0, 1, 2, 2)
