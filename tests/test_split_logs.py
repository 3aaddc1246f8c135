"""Records over file splits against the whole-file parser and by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from emberline.sources import raw_logs, split_logs


@pytest.fixture()
def small_splits(spark):
    """Files are cut into splits of 700 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "400"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_of(seed, n):
    rng = random.Random(seed)
    lines = ["orphan one", "", "  at orphan two"] if seed % 2 else []
    for i in range(n):
        thread = "" if i % 5 == 0 else f"[t{i % 3}] "
        lines.append(f"2015-10-18 18:01:{i % 60:02d},{i % 1000:03d} {rng.choice(['INFO', 'ERROR'])} {thread}org.x.C{i % 4}: message {i} é")
        for j in range(rng.choice([0, 0, 0, 1, 3, 40 if i % 25 == 0 else 0])):
            lines.append(rng.choice(["", "java.io.IOException: broken", f"\tat org.x.Y.call(Y.java:{j})", "x" * rng.randrange(1, 300)]))
    return lines


def test_splits_give_what_the_whole_file_gives(spark, small_splits, tmp_path):
    """Records that cross splits, a record over many splits, splits without any opening, blank lines, carriage returns, orphans, an empty file."""
    for name, lines in {"a.log": text_of(1, 120), "b.log": text_of(2, 60), "c.log": ["only", "orphans"] * 300, "e.log": text_of(4, 3)[:1] + ["y" * 90] * 200}.items():
        (tmp_path / name).write_text(("\r\n" if name == "b.log" else "\n").join(lines) + "\n", newline="")
    (tmp_path / "d.log").write_text("")
    lines = split_logs.read_splits(spark, str(tmp_path))
    assert lines.select("file", "split").distinct().count() > 60
    records, accounts = split_logs.assemble(lines, raw_logs.HADOOP)
    name = F.regexp_extract("file", "([^/]+)$", 1).alias("file")
    columns = ["ts", "millis", "level", "thread", "message", "continuations"]
    found = split_logs.parsed(records, raw_logs.HADOOP).orderBy("file", "split", "number").select(name, *columns).collect()
    whole = raw_logs.parse(raw_logs.read_lines(spark, str(tmp_path)), raw_logs.HADOOP).orderBy("file", "line_no").select("file", *columns).collect()
    assert found == whole and len(found) == 181 and max(r["continuations"] for r in found) == 200 and max(len(r["message"]) for r in found) == 2000
    expected = {r["file"]: tuple(r) for r in raw_logs.accounting(raw_logs.read_lines(spark, str(tmp_path)), raw_logs.HADOOP).collect()}
    assert {r["file"]: tuple(r) for r in accounts.select(name, "physical", "primary", "continuation", "orphan").collect()} == expected
    assert expected["c.log"] == ("c.log", 600, 0, 0, 600)


def test_no_line_is_shuffled(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(text_of(3, 5)))
    plan = split_logs.pieces(split_logs.read_splits(spark, str(tmp_path)), raw_logs.HADOOP)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_events_of_formats(spark):
    digest = lambda kind, value: f"{kind}-{hashlib.sha256(value.encode()).hexdigest()[:12]}"
    rows = [("app/container_1.log", 0, 1, "2015-10-18 18:01:47,978 WARN [main] org.x.Y: Failed job_14_0002", "java.net.NoRouteToHostException: no: route", 1), ("app/container_1.log", 0, 2, "2015-10-18 18:01:48,000 INFO plain", "", 0)]
    records = spark.createDataFrame(rows, "file string, split long, number long, head string, rest string, continuations long")
    a, b = split_logs.hadoop_events(split_logs.parsed(records, raw_logs.HADOOP), F.lit("application_14_0002")).orderBy("number").collect()
    assert (a["component"], a["error_type"], a["level"], a["workload_id"], a["execution_id"]) == ("org.x.Y", "java.net.NoRouteToHostException", "warn", digest("workload", "application_14_0002"), digest("execution", "container_1"))
    assert a["message"].startswith("Failed job_") and "0002" not in a["message"] and a["message"].endswith("no: route")
    assert (b["component"], b["error_type"], b["thread"], b["message"]) == ("unknown", None, "", "plain")
    uuid = "b9000564-fe1a-409b-b8cc-1e88b294cd1d"
    head = f"nova-compute.log.1 2017-05-16 00:00:04.500 2931 INFO nova.virt [req-{uuid} x] [instance: {uuid}] at 10.1.2.3 up"
    records = spark.createDataFrame([("f", 0, 1, head, "", 0)], records.schema)
    c = split_logs.openstack_events(split_logs.parsed(records, raw_logs.OPENSTACK)).first()
    assert (c["service"], c["level"], c["entity_key"], c["request_id"]) == ("nova-compute", "info", digest("instance", uuid), digest("request", f"req-{uuid}"))
    assert c["message"] == "[req-[UUID] x] [instance: [UUID]] at [IP] up"
    records = spark.createDataFrame([("f", 0, 1, "2015-07-29 17:41:41,536 - WARN  [main:QuorumPeerConfig@101] - from /10.1.1.1:80", "", 0)], records.schema)
    d = split_logs.zookeeper_events(split_logs.parsed(records, raw_logs.ZOOKEEPER)).first()
    assert (d["level"], d["component"]) == ("warn", "QuorumPeerConfig") and "10.1.1.1" not in d["message"]
