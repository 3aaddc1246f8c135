"""Corpora as tables of text: quoting, missing columns, truth apart, labels, traces."""

import datetime as dt
import hashlib

from emberline.sources import tabular_logs

CORPUS = 'LineId,Date,Time,Level,Component,Content,EventId\n1,081109,203615,INFO,dfs.X,"a ""b"", /10.1.1.1:50010 blk_-7",E5\n2,081109,5,,c,"two\nlines",\n3,bad,x,WARN,,,E6 \n'


def test_records_and_truth_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CORPUS)
    found, truth = tabular_logs.records(tabular_logs.read_csv(spark, str(tmp_path), multiline=True), "hdfs")
    assert "event_id" not in found.columns and {tuple(r) for r in truth.collect()} == {("1", "E5"), ("2", ""), ("3", "E6")}
    rows = {r["line_id"]: r for r in found.collect()}
    assert rows["1"]["message"] == 'a "b", /[IP]:50010 blk_[ID]' and rows["1"]["ts"] == dt.datetime(2008, 11, 9, 20, 36, 15)
    assert (rows["2"]["ts"], rows["2"]["level"], rows["2"]["message"]) == (dt.datetime(2008, 11, 9, 0, 0, 5), "info", "two\nlines")
    assert (rows["3"]["ts"], rows["3"]["level"], rows["3"]["component"], rows["3"]["message"]) == (None, "warn", "", "")
    spark_rows = spark.createDataFrame([("17/06/09", "20:10:40", "Changing view acls to: u\nend")], "Date string, Time string, Content string")
    record = tabular_logs.records(spark_rows, "spark")[0].first()
    assert record["ts"] == dt.datetime(2017, 6, 9, 20, 10, 40) and record["line_id"] == "" and record["message"] == "Changing view acls to: u\nend"
    one_line = tabular_logs.records(spark_rows.selectExpr("Date", "Time", "'Changing view acls to: u' AS Content"), "spark")[0].first()
    assert one_line["message"] == "Changing view acls to: [USER_SET]"
    assert tabular_logs.records(spark_rows.limit(0), "spark")[0].count() == 0


def test_dictionaries_and_labels(spark, tmp_path):
    rows = spark.createDataFrame([("E1 ", "tmpl"), ("", "no"), (None, "no"), ("b", "Normal"), ("b", "Anomaly")], "EventId string, V string")
    assert {tuple(r) for r in tabular_logs.dictionary(rows, "EventId", "V", lower=True).collect()} == {("E1", "tmpl"), ("b", "normal")}
    (tmp_path / "labels.txt").write_text("+ early\n### Sort\n+ none\nNormal:\n+ app1 \r\nDisk full:\n\n+ app2\nOther:\n+ app3\n### Count\n+ app4\nMachine down:\n+ app1\n")
    found = {r["application"]: (r["workload"], r["outcome"]) for r in tabular_logs.outcome_labels(spark, str(tmp_path)).collect()}
    assert found == {"app1": ("Count", "machine_down"), "app2": ("Sort", "disk_full"), "app3": ("Sort", "disk_full")}


def test_traces(spark):
    traces = spark.createDataFrame([("c1", f"t{i}", "2024-01-01 00:00:0%d" % i) for i in range(4)] + [("c2", "x", "when"), ("c3", " ", "2024-01-01 00:00:00"), ("c4", "y", "2024-01-01 00:00:00")], "case string, TaskID string, FirstSeen string")
    least = min((f"t{i}" for i in range(4)), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    chosen = tabular_logs.chosen_traces(traces, "case")
    assert {r["case"]: r["TaskID"] for r in chosen.collect()} == {"c1": least, "c4": "y"}
    allowed = spark.createDataFrame([("c1", "t3"), ("c4", "none")], "case string, TaskID string")
    assert [(r["case"], r["TaskID"]) for r in tabular_logs.chosen_traces(traces, "case", allowed).collect()] == [("c1", "t3")]
    events = spark.createDataFrame([("c1", least, "read", "IOException at 10.1.1.1:", "n1"), ("c1", least, None, None, None), ("c1", "other", "x", "y", "z"), ("c4", "y", "op", "fine", "n2")], "case string, TaskID string, OpName string, Description string, Agent string")
    found = sorted((r["case"], r["level"], r["event_name"], r["message"], r["execution_id"]) for r in tabular_logs.trace_records(events, chosen, "case").collect())
    scoped = lambda t: "trace-" + hashlib.sha256(t.encode()).hexdigest()[:16]
    assert found == [("c1", "error", "read", "read: IOException at [IP]:", scoped(least)), ("c1", "info", "", ": ", scoped(least)), ("c4", "info", "op", "op: fine", scoped("y"))]
