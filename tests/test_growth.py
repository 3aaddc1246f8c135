"""Steps that are done once, or whose work is bounded, however many records there are."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from emberline.functions import sanitize, text
from emberline.operators import correlation, counters, grouping, incidents, sampling
from emberline.plans import catalogue, source_queries
from emberline.sources import split_logs
from emberline.storage import shared_dir


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id")


@pytest.mark.parametrize("name", ["rule_file_matches", "deploy_window_semi", "pair_candidates", "family_cover"])
def test_records_are_grouped_once(spark, sf, name):
    assert scans(catalogue.queries()[name](spark, sf)) <= 1  # deployments only


def test_fingerprint_in_steps(spark):
    messages = [
        None, "", "SQLSTATE[53300] after 12.5 ms", "HTTP 503 for user_id=42 HTTP 504", "xhttp 504 then http 504", "status=200 sqlstate[ab123]", "error_code=http 500", "__semanticcodea__ status=404",
        "__semanticcodea__", "errno=ab", "status __semanticcodeb__ http 99", "commit deadbeef12 task_000742 0xFF", "at Mon Jan 1 00:00:00 2026 done", "[req-[uuid] x] Host=a blk_[ID] blk_[id] trace-id=1 req_id=2", "x" * 300,
        " ".join(f"http {i}" for i in range(100, 140)),
    ]
    rows = spark.createDataFrame([(m, "kept") for m in messages], "`a.m` string, work string")
    found = text.with_fingerprint(rows, "s", "a.m")
    assert found.columns == ["a.m", "work", "s"]
    assert found.select("s").exceptAll(rows.select(text.fingerprint(F.col("`a.m`")).alias("s"))).count() == 0
    assert found.count() == len(messages)
    assert found.filter("`a.m` = 'HTTP 503 for user_id=42 HTTP 504'").first()["s"] == "http_status=503 for user_id=? http_status=504"


def test_signals_only_tried_where_they_may_match(spark):
    rows = spark.createDataFrame([("Connection REFUSED", "info"), (None, "error"), ("KERNEL  Panic", "info"), ("fine", "info")], "m string, l string")
    found = [r[0] for r in rows.select(text.detect_signals(F.col("m"), F.col("l"))["rule_id"]).collect()]
    assert found == [["network-disconnect"], ["source-level-unclassified-error"], ["process-failure"], []]


def test_samples_are_summed_before_the_grid(spark):
    rows = spark.range(6000).select(F.lit("a").alias("s"), F.timestamp_micros(F.col("id") * 100_000 + 1_700_000_000_000_000).alias("ts"), F.col("id").cast("double").alias("value"))
    once = counters.rate_on_grid(rows, ["s"], step=60, span=300)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("Generate explode"):]
    assert dealt.index("Aggregate") < dealt.index("Window")
    odd = counters.rate_on_grid(rows, ["s"], step=60, span=310)  # by sample
    assert once.count() == odd.count() == 15
    assert {round(r["rate"], 6) for r in once.filter("at >= 1700000340 AND at <= 1700000580").collect()} == {10.0}


def test_messages_are_rewritten_once_and_alike(spark):
    messages = [
        None, "", "plain", "from 10.1.2.3 (host.example) blk_-12 /user/bob/x", "Application_1_2 JOB_3_4Job attempt_1_2_3 msra-SA-12 /tmp/hadoop-root/x", "TOKEN=abc Bearer xyz sk-abcdefghijklmnop1 ghp_abcdefghijklmnop1",
        "mail Bob@Example.COM card 4111 1111 1111 1111 user=u host=h", "java.io.IOException: token: Error", "XOXB-abcdefghijklmnop1 x\\n java.lang.NoError a: b", "1.2.3.4", "api-key='k' secret = s",
    ]
    rows = spark.createDataFrame([(m, i) for i, m in enumerate(messages)], "`a.m` string, i long")
    found = sanitize.with_hadoop_message(rows, "a.m")
    assert found.columns == rows.columns
    assert found.exceptAll(rows.select(sanitize.hadoop_message(F.col("`a.m`")), "i")).count() == 0
    records = spark.range(3).select(F.lit("f").alias("file"), F.lit("INFO").alias("level"), F.concat(F.lit("a.B: no Exceptions "), F.col("id").cast("string")).alias("message"))
    events = split_logs.hadoop_events(records, F.col("file"))
    assert events._jdf.queryExecution().optimizedPlan().toString().count("bmsra-sa-") == 1
    assert {r["error_type"] for r in events.collect()} == {None}


def test_printed_parts_follow_the_session(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        source_queries.printed_records(spark, sf)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    folder = max(glob.glob(f"{shared_dir(spark)}/printed-*"), key=os.path.getmtime)
    assert len({f.split("/part-")[1][:5] for f in glob.glob(f"{folder}/*/part-*.txt")}) > 8


def test_representative_sample_ranks_few_records(spark):
    """Windows are over ends of signals and shapes, counts of minutes, and the records of minutes that are sampled: not over all records."""
    rows = spark.range(20_000).selectExpr("id AS ordinal", "timestamp_seconds(id * 4) AS ts", "concat('s', id % 3) AS signature", "'error' AS level", "IF(id = 7, 'disk full', NULL) AS message", "id % 2 = 0 AS important", "'i' AS incident")
    found = sampling.representative_sample(rows, "signature", 60, "important")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if ": Window [" in line or "- Window [" in line]
    assert windows and all("minute" in line for line in windows if "ordinal" in line)
    got = sorted(r["ordinal"] for r in found.collect())
    taken = {r["ordinal"] for r in found.filter("stage < 4").collect()}
    rest = [i for i in range(20_000) if i not in taken]
    room = 60 - (20_000 - len(rest))
    assert len(got) == 60 and {0, 7, 19_999} <= set(got)
    assert {rest[round(i * (len(rest) - 1) / (room - 1))] for i in range(room)} <= set(got)


def test_steps_are_not_put_into_filters_and_keys(spark, monkeypatch):
    """Filters and join keys over a text that was rewritten in steps take its name, not its steps: those would grow as a power of their number. Four steps show it."""
    monkeypatch.setattr(text, "VOLATILE", [r for r in text.VOLATILE if "id" in r[1] or "time" in r[1]][:4])
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    rows = spark.range(20).select("id", F.concat(F.lit("seen trace_id=a"), "id").alias("m"))
    signed = text.with_fingerprint(rows.withColumn("part", F.col("id") % 2), "s", "m")
    rewritten = sanitize.with_rewritten(rows, "m", sanitize.HADOOP[:4])
    for found, name in ((signed, "s"), (rewritten, "m")):
        assert size(found.filter(F.contains(F.lower(name), F.lit("trace")))) < size(found) + 2000
        parts = [found.filter(F.col("id") % 2 == i).groupBy(F.concat(F.lit("a"), name).alias("key")).agg(F.count(F.lit(1)).alias("score")) for i in (0, 1)]
        joined = incidents.candidate_changes(*parts, "key")
        assert size(joined) < 2 * size(found) + 4000
        assert "Filter" in signed.filter("part = 1")._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[1]  # other filters pass
    assert signed.filter(F.col("s") == "seen trace_id=?").count() == 20
    changes = incidents.candidate_changes(*[signed.filter(F.col("part") == i).groupBy("s").agg(F.count(F.lit(1)).alias("score")) for i in (0, 1)], "s")
    assert [tuple(r) for r in changes.collect()] == [("seen trace_id=?", 10, 10, "unchanged")]


def test_dependencies_are_sought_in_names_of_signatures(spark, monkeypatch):
    """The filter on signatures goes below the groups, but not below the steps of the fingerprint."""
    monkeypatch.setattr(text, "VOLATILE", [r for r in text.VOLATILE if "id" in r[1] or "time" in r[1]][:4])
    said = [("a", "upstream gone trace_id=1"), ("a", "upstream gone trace_id=2"), ("b", "Dependency down"), ("b", "dependency DOWN"), ("c", "fine"), ("c", "fine"), ("c", "fine")]
    rows = spark.createDataFrame([(i, s, m) for i, (s, m) in enumerate(said)], "ordinal long, service string, message string").selectExpr(
        "*", "timestamp_seconds(ordinal) AS ts", "'error' AS level", "CAST(NULL AS STRING) AS error_type", "'e' AS event_name", "'500' AS status_code", "'p' AS pod", "'h' AS host")
    groups = grouping.label_groups(rows)
    found = incidents.dependency_candidates(groups)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2 * len(groups._jdf.queryExecution().optimizedPlan().toString())
    assert plan.index("Filter") < plan.index("Generate explode")
    first = groups.filter("service = 'a'").first()  # two of each: the one that came first
    assert [tuple(r) for r in found.collect()] == [("1970-01-01", first["event_id"], f"candidate-dependency-{first['event_id']}", "dependency_failure", 42)]


@pytest.mark.parametrize("name", ["entity_links", "temporal_links"])
def test_links_read_a_written_timeline(spark, sf, name):
    assert scans(catalogue.queries()[name](spark, sf)) == 0


def test_events_of_one_incident_meet_their_anchor_in_many_tasks(spark):
    events = spark.range(2000).selectExpr("IF(id < 1990, 'day', IF(id = 1999, NULL, 'other')) AS incident", "concat('e', id) AS event_id", "'s' AS service", "timestamp_seconds(id) AS at")
    anchors = spark.createDataFrame([("day", "e7", "s", 7), ("other", "e1990", "s", 1990)], "incident string, anchor_id string, anchor_service string, t long").selectExpr("* EXCEPT (t)", "timestamp_seconds(t) AS anchor_at")
    asked = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        found = correlation.temporal_links(events, anchors).select("incident", "event_id", "relationship", "offset", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r["task"] for r in found if r["incident"] == "day"}) > 1
    assert len(found) == 1989 + 8 and {r["event_id"] for r in found} == {f"e{i}" for i in range(1999)} - {"e7", "e1990"}
    assert {tuple(r)[1:4] for r in found if r["event_id"] in ("e6", "e70", "e1991")} == {("e6", "precedes_anchor", "T-0m01s"), ("e70", "follows_anchor", "T+1m03s"), ("e1991", "follows_anchor", "T+0m01s")}
