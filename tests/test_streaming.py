"""Streaming forms against their batch twins over the same events."""

from pyspark.sql import functions as F

from emberline.operators import store
from emberline.sources.relations import logs
from emberline.streaming import admission


def source(spark, sf, tmp_path):
    rows = logs(spark, sf).select("ordinal", "ts", "service", "event_name").orderBy("ordinal")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.option("maxRecordsPerFile", 300).parquet(path)
    return rows, admission.read_events(spark, path, rows.schema, files_per_batch=10)


def finished(spark, stream, tmp_path, schema=None):
    out = str(tmp_path / "out")
    admission.append_to(stream, out, str(tmp_path / "checkpoint")).awaitTermination(120)
    return spark.read.parquet(out)


def test_admission(spark, sf, tmp_path):
    rows, stream = source(spark, sf, tmp_path)
    key = F.concat_ws("|", "service", "event_name", F.date_format("ts", "yyyy-MM-dd HH"))
    found = finished(spark, admission.admit(stream, key, "40 days"), tmp_path)
    expected = store.admit(rows, key, ["ordinal"]).filter("admitted")
    assert found.count() == expected.count()
    assert sorted(r[0] for r in found.select("idempotency_key").collect()) == sorted(r[0] for r in expected.select("idempotency_key").collect())


def test_buckets(spark, sf, tmp_path):
    rows, stream = source(spark, sf, tmp_path)
    found = {(r["service"], r["start"]): r["events"] for r in finished(spark, admission.bucket_counts(stream, ["service"], "1 hour", "1 hour"), tmp_path).collect()}
    whole = {(r["service"], r["start"]): r["n"] for r in rows.groupBy("service", store.bucket_start(F.col("ts"), 3600).alias("start")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # What the watermark has not passed at the end stays in state.
    assert found and all(whole[k] == v for k, v in found.items()) and len(whole) - len(found) < 20


def test_coalescing(spark, sf, tmp_path):
    rows, stream = source(spark, sf, tmp_path)
    jobs = admission.coalesced(stream.select(F.col("service").alias("incident"), "ts", "ordinal"), 3600, 7200, "1 hour")
    found = {(r["incident"], r["payload"]): (r["events"], r["available_at"]) for r in finished(spark, jobs, tmp_path).collect()}
    batch = store.coalesced_jobs(rows.select(F.col("service").alias("incident"), "ts", "ordinal"), 3600, 7200)
    whole = {(r["incident"], r["payload"]): (r["events"], r["available_at"]) for r in batch.collect()}
    assert found and all(whole[k] == v for k, v in found.items()) and len(whole) - len(found) <= 10


def test_future_times_are_rejected(spark, sf, tmp_path):
    rows, _ = source(spark, sf, tmp_path)
    assert admission.reject_future(rows, F.col("ts") - F.expr("INTERVAL 6 minutes")).count() == 0
    assert admission.reject_future(rows, F.col("ts")).count() == rows.count()
