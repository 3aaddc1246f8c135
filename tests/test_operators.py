"""Operator tests on literal rows: edge cases and invariants."""

import hashlib
import random
import re
from datetime import datetime, timedelta
from statistics import median

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import correlation, grouping, quality, sampling, scoring, statistics, store
from emberline.sources import raw_logs


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def fingerprint(spark, message):
    return one(spark, text.fingerprint(F.col("m")), m=message)


def test_fingerprint_keeps_codes_and_drops_values(spark):
    assert fingerprint(spark, "SQLSTATE[53300] after 12.5 ms") == "sqlstate=53300 after <measure>"
    assert fingerprint(spark, "SQLSTATE[53300]") != fingerprint(spark, "SQLSTATE[08006]")
    assert fingerprint(spark, "HTTP 503 for user_id=42 HTTP 504") == "http_status=503 for user_id=? http_status=504"
    assert fingerprint(spark, "got 900 B") == fingerprint(spark, "got 5.2 KB")
    assert fingerprint(spark, "commit deadbeef12 task_000742 0xFF") == "commit <hex> task_<num> <hex>"
    assert fingerprint(spark, "at Mon Jan 1 00:00:00 2026 done") == "at <timestamp> done"
    assert fingerprint(spark, None) == ""
    assert fingerprint(spark, "  a \n\t b ") == "a b"


def test_fingerprint_cuts_in_the_middle(spark):
    found = fingerprint(spark, "x" * 150 + "y" * 150)
    assert found == "x" * 120 + " … " + "y" * 56


def test_redaction(spark):
    cases = {
        "password=hunter2 ok": "password=[REDACTED] ok", "mail bob@example.com": "mail [EMAIL_REDACTED]", "at 10.0.0.1 now": "at [IP_REDACTED] now",
        "Bearer abc.def": "Bearer [REDACTED]", "user = root;": "user=[USER_REDACTED];", "4111 1111 1111 1111": "[CARD_REDACTED]", "": "",
    }
    for message, expected in cases.items():
        once = one(spark, text.redact_message(F.col("m")), m=message)
        assert once == expected
        assert one(spark, text.redact_message(F.col("m")), m=once) == once


def test_redact_data_and_labels(spark):
    row = spark.createDataFrame([({"Token": "abc", "pod": "p a@b.io", "session_token_x": "s"},)], "m map<string,string>")
    data = row.select(text.redact_data(F.col("m")).alias("x")).first()["x"]
    assert data["Token"] == "redacted-" + hashlib.sha256(b":abc").hexdigest()[:12]
    assert data["pod"] == "p [EMAIL_REDACTED]" and data["session_token_x"].startswith("redacted-")
    labels = row.select(text.redact_labels(F.col("m")).alias("x")).first()["x"]
    assert labels["pod"] == "p a@b.io" and labels["session_token_x"] == "s"
    again = spark.createDataFrame([(data,)], "m map<string,string>").select(text.redact_data(F.col("m")).alias("x")).first()["x"]
    assert again == data


def test_signals_and_fallback(spark):
    families = lambda m, level: [s["signal_family"] for s in one(spark, text.detect_signals(F.col("m"), F.col("l")), m=m, l=level)]
    assert families("connection refused by peer", "error") == ["network_transport"]
    assert families("nothing known", "error") == ["unclassified_error"]
    assert families("nothing known", "info") == []
    assert families(None, None) == []
    assert one(spark, text.operation_effect(F.col("m")), m="checksum error") == "block_operation_failed"


def test_codes(spark):
    assert one(spark, text.decorate(F.col("m")), m="got HTTP 504") == "got HTTP 504  [HTTP 504: Gateway Timeout — upstream slow]"
    assert one(spark, text.decorate(F.col("m")), m="got HTTP 999") == "got HTTP 999"


def test_time_normalisation(spark):
    rows = [("2024-01-01T12:00:00+02:00",), ("2024-01-01T09:59:00Z",), ("2024-01-01T09:00:00",), ("x",), ("",), (None,), ("2030-01-01T00:00:00Z",)]
    df = spark.createDataFrame(rows, "t string")
    when, kind = quality.normalize_time(F.col("t"), F.lit("2024-01-01 11:00:00").cast("timestamp"))
    found = [(r[0] and r[0].strftime("%H:%M"), r[1]) for r in df.select(when.alias("a"), kind.alias("b")).collect()]
    assert found == [("10:00", "verified"), ("09:59", "verified"), ("09:00", "assumed_utc"), (None, "invalid"), (None, "missing"), (None, "missing"), (None, "future")]


LOG = "ordinal long, ts timestamp, service string, level string, error_type string, event_name string, status_code string, pod string, host string, trace_id string, user_id long, message string"


def log_rows(n=60, seed=3):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [
        (i, start + timedelta(seconds=rng.randrange(7200)), rng.choice(["a", "b", None]), rng.choice(["error", "info"]), None, "e", None, f"p{i % 3}", "h", "t", i % 4, rng.choice(["took 5 ms", "took 9 ms", "no route to host", None, ""]))
        for i in range(n)
    ]


def test_grouping_ignores_order_and_conserves(spark):
    rows = log_rows()
    columns = ["event_id", "n", "first_seen", "last_seen", "example_message"]
    a = grouping.label_groups(spark.createDataFrame(rows, LOG)).select(columns).collect()
    b = grouping.label_groups(spark.createDataFrame(rows[::-1], LOG)).select(columns).collect()
    assert sorted(a) == sorted(b) and sum(r["n"] for r in a) == len(rows)
    assert grouping.label_groups(spark.createDataFrame([], LOG)).count() == 0


def test_quality_conserves(spark):
    rows = spark.createDataFrame(log_rows() + log_rows(10), LOG).withColumn("time_quality", F.lit("verified"))
    report = quality.quality_report(quality.assess(rows, ["service"], ["ts", "service", "message"]), ["event_name"]).first()
    assert report["input_records"] == 70 == report["usable_records"] + report["quarantined_records"] + report["duplicate_records"]
    assert report["quarantined_records"] == sum(r[2] is None for r in log_rows() + log_rows(10))


def test_deploys_match_null_services(spark):
    t = datetime(2024, 1, 1, 12)
    groups = spark.createDataFrame([("g1", "a", t), ("g2", None, t), ("g3", "", t)], "event_id string, service string, first_seen timestamp")
    deploys = spark.createDataFrame(
        [(1, t - timedelta(minutes=15), "a", "c"), (2, t - timedelta(minutes=3), None, "c"), (3, t - timedelta(minutes=3), "b", "c"), (4, t + timedelta(seconds=1), "a", "c"), (5, t - timedelta(minutes=16), "a", "c")],
        "deploy_id long, deployed_at timestamp, service string, commit string")
    found = sorted((r["event_id"], r["deploy_id"]) for r in correlation.deploys_before(groups, deploys).collect())
    assert found == [("g1", 1), ("g1", 2), ("g2", 1), ("g2", 2), ("g2", 3), ("g3", 1), ("g3", 2), ("g3", 3)]


def test_offset_labels(spark):
    df = spark.createDataFrame([(185.9,), (-7620.0,), (None,), (0.0,)], "s double")
    assert [r[0] for r in df.select(correlation.offset_label(F.col("s"))).collect()] == ["T+3m05s", "T-2h07m", "T?", "T+0m00s"]


def test_peer_baseline_flags_the_slow_one(spark):
    rows = [("slow", "c", 40.0), *[(f"o{i}", "c", float(19 + i % 3)) for i in range(20)], ("lone", "d", 5.0)]
    found = {r["operation_id"]: r for r in statistics.peer_baselines(spark.createDataFrame(rows, "operation_id string, cohort string, duration double")).collect()}
    assert len(found) == len(rows)
    assert found["slow"]["status"] == "deviation_observed" and found["slow"]["peer_count"] == 20
    assert found["lone"]["status"] == "insufficient_baseline" and found["lone"]["center"] is None
    assert found["o0"]["status"] == "within_peer_baseline"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=2, max_size=14))
def test_peer_baseline_against_definition(spark, values):
    rows = [(i, "c", float(v)) for i, v in enumerate(values)]
    for r in statistics.peer_baselines(spark.createDataFrame(rows, "operation_id long, cohort string, duration double")).collect():
        peers = [float(v) for i, v in enumerate(values) if i != r["operation_id"]]
        center = median(peers)
        assert (r["center"], r["mad"]) == (center, median(abs(p - center) for p in peers))
        assert abs(r["percentile_rank"] - 100 * sum(p <= r["duration"] for p in peers) / len(peers)) < 1e-9


def test_pairwise_metrics(spark):
    assigned = spark.createDataFrame([(i, "c", p) for i, p in enumerate("xxxyy")], "ordinal long, case string, predicted string")
    truth = spark.createDataFrame([(i, t) for i, t in enumerate("aabbb")], "ordinal long, label string")
    r = statistics.pairwise_grouping(assigned, truth).first()
    assert (r["tp"], r["fp"], r["fn"], r["collisions"], r["fragmented"]) == (2, 2, 2, 1, 1)
    assert (r["precision"], r["recall"], r["purity"]) == (0.5, 0.5, 0.8)


def test_samples_keep_bounds(spark):
    df = spark.createDataFrame(log_rows(200), LOG).withColumn("incident", F.lit("i"))
    rows = grouping.with_signature(df).withColumn("important", F.col("level") == "error")
    found = sampling.representative_sample(rows, "signature", 40, "important").collect()
    whole = rows.collect()
    assert len(found) == 40
    assert {r["signature"] for r in found} == {r["signature"] for r in whole}
    assert min(r["ts"] for r in found) == min(r["ts"] for r in whole) and max(r["ts"] for r in found) == max(r["ts"] for r in whole)
    assert sampling.even(df, ["incident"], ["ts", "ordinal"], 7).count() == 7
    assert sampling.time_slices(df, ["incident"], 4, 10).count() == 10


def test_store(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", 1, t, "x"), ("k", 2, t, "x"), ("k", 3, t, None), ("k", 4, t, "x")], "key string, ordinal long, ts timestamp, v string")
    assert [r["version"] for r in store.versions(rows, "key", ["ordinal"], ["v"]).orderBy("ordinal").collect()] == [1, 2, 3]
    limited = store.rate_limited(rows, "key", 60, 2).orderBy("ordinal").collect()
    assert [r["allowed"] for r in limited] == [True, True, False, False] and limited[2]["retry_after"] == 60
    old, new = (spark.createDataFrame(x, "k string, d string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("b", "2"), ("c", "1"), ("d", "1")]))
    assert {r["k"]: r["change"] for r in store.revision_diff(old, new, "k", "d").collect()} == {"a": "removed", "b": "changed", "c": "unchanged", "d": "added"}


def test_scoring_rules(spark):
    df = spark.createDataFrame([(0, "critical", False), (1, "warning", False), (2, "high", True), (2, "high", False), (1, None, None)], "t int, a string, c boolean")
    assert [r[0] for r in df.select(scoring.severity(F.col("t"), F.col("a"), F.col("c"))).collect()] == ["SEV2", "SEV3", "SEV3", "SEV4", "SEV4"]
    history = spark.createDataFrame([("e", 1, "received"), ("e", 2, "collecting"), ("e", 3, "approved")], "entity string, version int, state string")
    assert [(r["before"], r["state"]) for r in scoring.illegal_transitions(history).collect()] == [("collecting", "approved")]


def lines_of(spark, *lines):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")


def test_parsers(spark):
    lines = lines_of(spark, "orphan", "2015-10-18 18:01:47,978 ERROR [main] org.X: failed", "java.io.IOException: x", "\tat y", "2015-10-18 18:01:48,000 INFO [t] ok")
    found = raw_logs.parse(lines, raw_logs.HADOOP).orderBy("line_no").collect()
    assert [(r["level"], r["continuations"]) for r in found] == [("ERROR", 2), ("INFO", 0)]
    assert found[0]["message"] == "org.X: failed\njava.io.IOException: x\n\tat y"
    counts = raw_logs.accounting(lines, raw_logs.HADOOP).first()
    assert counts["physical"] == counts["primary"] + counts["continuation"] + counts["orphan"] == 5
    hdfs = raw_logs.parse(lines_of(spark, "081109 3518 143 INFO dfs.DataNode: Receiving blk_-16 src"), raw_logs.HDFS)
    assert hdfs.first()["ts"] == datetime(2008, 11, 9, 0, 35, 18)
    assert raw_logs.block_events(hdfs, spark.createDataFrame([("blk_-16",)], "block string")).count() == 1
    zk = raw_logs.parse(lines_of(spark, "2015-07-29 17:41:41,536 - INFO  [main:QuorumPeerConfig@101] - Reading"), raw_logs.ZOOKEEPER).first()
    assert (zk["component"], zk["thread"], zk["message"]) == ("QuorumPeerConfig", "main", "Reading")
    bgl = raw_logs.parse(lines_of(spark, "- 1117838570 2005.06.03 R02 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO parity error corrected"), raw_logs.BGL).first()
    assert bgl["truth"] == "-" and bgl["ts"].microsecond == 363779
    stack = raw_logs.parse(lines_of(spark, "nova.log 2017-05-16 00:00:00.008 2931 INFO nova.x [req-1] done"), raw_logs.OPENSTACK).first()
    assert stack["source"] == "nova.log" and stack["message"] == "[req-1] done"


def test_spark_lines_carry_time(spark):
    found = raw_logs.parse_spark(lines_of(spark, "17/06/09 20:10:40 INFO x.Y: start", "java.lang.RuntimeException: no", "what is this")).orderBy("line_no").collect()
    assert [r["kind"] for r in found] == ["record", "exception", "unparsed"]
    assert found[0]["ts"] == found[1]["ts"] and found[1]["level"] == "ERROR"


def test_spark_exceptions_of_the_reference_forms(spark):
    lines = lines_of(spark, "java.lang.Error: before any record", "17/06/09 20:10:40 INFO x.Y: start", 'Exception in thread "main" java.lang.Error: java.io.IOException: gone', "Caused by: x.Y: no", "\tat a.b(C.java)", "org.apache.SparkException: Job aborted")
    found = raw_logs.parse_spark(lines).orderBy("line_no").collect()
    assert [r["kind"] for r in found] == ["unparsed", "record", "exception", "unparsed", "unparsed", "exception"]
    assert found[2]["message"] == "java.io.IOException: gone" and found[5]["message"] == "Job aborted" and found[2]["ts"] == found[1]["ts"]
    bgl = raw_logs.parse(lines_of(spark, "-  1117838570 2005.06.03  R02 2005-06-03-15.42.50.363779 R02  RAS KERNEL INFO   parity"), raw_logs.BGL).first()
    assert bgl["message"] == "parity"


def test_canonical_json_as_python_writes_it(spark):
    import json

    from emberline.functions import text

    payload = {"a": {"k": "é ß 😀 \"q\" \\ /", "z": "1"}, "b": None}
    df = spark.createDataFrame([(payload["a"], None)], "a map<string,string>, b string")
    found = df.select(text.canonical_json(F.struct(text.sorted_map(F.col("a")).alias("a"), "b"))).first()[0]
    assert found == json.dumps(payload, sort_keys=True, separators=(",", ":"))


def test_jobs_end_at_their_deadline(spark):
    from emberline.operators import store

    rows = [("i", f"2024-01-01 00:00:{s:02d}", n) for n, s in enumerate((0, 4, 8, 12, 20))] + [("i", "2024-01-01 00:01:00", 9)]
    events = spark.createDataFrame(rows, "incident string, t string, ordinal long").select("incident", F.to_timestamp("t").alias("ts"), "ordinal")
    found = [(r["job"], r["events"], r["payload"]) for r in store.coalesced_jobs(events, 5, 10).orderBy("job").collect()]
    assert found == [(1, 3, 2), (2, 1, 3), (3, 1, 4), (4, 1, 9)]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    assert [tuple(r) for r in raw_logs.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [("a.log", 0, "one"), ("a.log", 1, "two")]


def test_no_row_functions_in_plans(spark, sf):
    from emberline.plans import catalogue

    for name in ("label_groups_full", "detect_rules", "impact_assessment", "peer_duration_features"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Python|CartesianProduct|NestedLoop", plan), name


def test_lifecycles_take_every_purchase(spark, sf):
    from emberline.plans import evidence_queries
    from emberline.sources.relations import logs

    rows = logs(spark, sf).filter("event_name = 'purchase'").selectExpr("date_format(ts, 'yyyy-MM-dd') AS d", "k", "host", "ordinal").collect()
    expected = {}
    for r in rows:
        key = (r["d"], ("failed", "succeeded", "resumed")[r["k"] % 3], r["host"])
        expected[key] = min(expected.get(key, r["ordinal"]), r["ordinal"])
    found = {(r["incident"], r["status"], r["hosts"][0]): r["event_id"] for r in evidence_queries.lifecycles(spark, sf).collect()}
    assert found == {k: f"job-{n}" for k, n in expected.items()}


def test_representative_sample_budgets(spark):
    """More signal shapes than the limit: late ones, general shapes and the time fill keep their parts."""
    rows = [(i, i, f"e{i // 2}" if i < 200 else f"g{(i - 200) // 10}", "error" if i < 200 else "info", "odd" if i != 151 else "no space left on device") for i in range(400)]
    df = spark.createDataFrame(rows, "ordinal long, t long, signature string, level string, message string").selectExpr("*", "timestamp_seconds(t) AS ts", "'i' AS incident", "level = 'error' AS important")
    found = sampling.representative_sample(df, "signature", 60, "important").collect()
    assert len(found) == 60 and {0, 399, 151} <= {r["ordinal"] for r in found}
    stages = [sum(r["stage"] == s for r in found) for s in range(5)]
    assert stages[0] == 2 and 1 <= stages[1] <= 15 and 10 <= stages[2] <= 20 and 10 <= stages[3] <= 20 and stages[4] >= 3
    assert max(r["ordinal"] for r in found if r["stage"] == 2) > 180 and any(r["ordinal"] >= 200 for r in found if r["stage"] == 3)
    few = sampling.representative_sample(df.limit(20), "signature", 60, "important")
    assert few.count() == 20 and sampling.representative_sample(df, "signature", 1, "important").count() == 1
