"""Log corpora as tables of text files: structured records, event templates, labels, and traces with their events.

What a corpus knows of the truth (event ids, labels) is read apart from the records, so that nothing can use it before it is joined on purpose.
Files are CSV with a header; a quoted field may hold line ends only where `multiline` is set, because such files can't be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import sanitize
from emberline.functions.text import redact_message, scoped_id

# Layouts of time, signs of failure in traces, outcomes of a label file, places that ids are cut to.
TIMES = {"hdfs": "yyMMddHHmmss", "spark": "yy/MM/ddHH:mm:ss"}
TRACE_FAILURE = r"(?i)(?:ioexception|socketexception|checksum\s+error|connection\s+(?:reset|refused)|broken\s+pipe|could\s+not|no\s+live\s+nodes|\b(?:error|failed|failure)\b)"
OUTCOMES = {"Normal": "normal", "Machine down": "machine_down", "Network disconnection": "network_disconnection", "Disk full": "disk_full"}
TRACE_DIGITS, MESSAGE_LIMIT = 16, 2000


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as texts; quotes are doubled inside quoted fields; empty fields are empty texts."""
    return spark.read.options(header=True, escape='"', multiLine=multiline, nullValue="\u0000", emptyValue="").csv(path)


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def records(rows: DataFrame, service: str) -> tuple[DataFrame, DataFrame]:
    """(line_id, ts, service, level, component, message) and, apart, (line_id, event_id) of a corpus of `hdfs` or `spark` rows.

    A time that can't be read is null, a missing level is info; messages are sanitized. Rows keep their line ids, also where these repeat.
    """
    clock = F.lpad(_text(rows, "Time"), 6, "0") if service == "hdfs" else _text(rows, "Time")
    ts = F.try_to_timestamp(F.concat(_text(rows, "Date"), clock), F.lit(TIMES[service]))
    clean = sanitize.spark_message if service == "spark" else sanitize.public_message
    level = F.coalesce(F.nullif(F.lower(_text(rows, "Level")), F.lit("")), F.lit("info"))
    found = rows.select(_text(rows, "LineId").alias("line_id"), ts.alias("ts"), F.lit(service).alias("service"), level.alias("level"), _text(rows, "Component").alias("component"), clean(_text(rows, "Content")).alias("message"))
    return found, rows.select(_text(rows, "LineId").alias("line_id"), F.trim(_text(rows, "EventId")).alias("event_id"))


def dictionary(rows: DataFrame, key: str, value: str, lower: bool = False) -> DataFrame:
    """key, value of a table of templates or labels, trimmed, one row a key: the last by line is not known to Spark, so of different values the greatest counts."""
    found = F.lower(F.trim(_text(rows, value))) if lower else F.trim(_text(rows, value))
    return rows.select(F.trim(_text(rows, key)).alias("key"), found.alias("value")).filter("key <> ''").groupBy("key").agg(F.max("value").alias("value"))


def outcome_labels(spark: SparkSession, path: str) -> DataFrame:
    """application, workload, outcome of label files: `### workload`, `Outcome:` and `+ application` lines; what follows neither is no label. Label files are small and read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    heading = F.when(F.startswith("line", F.lit("### ")), F.trim(F.substring("line", 5, 1000)))
    named = F.when(F.endswith("line", F.lit(":")), F.regexp_replace("line", ":$", ""))
    outcome = F.when(heading.isNotNull(), F.lit("")).when(named.isin(*OUTCOMES), named)  # a new workload has no outcome yet
    so_far = Window.partitionBy("file").orderBy("at")
    rows = lines.withColumns({"workload": F.last(heading, ignorenulls=True).over(so_far), "outcome": F.last(outcome, ignorenulls=True).over(so_far)})
    found = rows.filter(F.startswith("line", F.lit("+ ")) & F.col("workload").isNotNull() & F.col("outcome").isin(*OUTCOMES))
    code = F.try_element_at(F.create_map(*[F.lit(x) for item in OUTCOMES.items() for x in item]), F.col("outcome"))
    return found.select(F.trim(F.substring("line", 3, 1000)).alias("application"), "workload", code.alias("outcome"), "file", "at").groupBy("application").agg(
        F.max_by(F.struct("workload", "outcome"), F.struct("file", "at")).alias("v")).select("application", "v.workload", "v.outcome")


def chosen_traces(traces: DataFrame, case: str, allowed: DataFrame | None = None) -> DataFrame:
    """Of each case the trace whose id has the least SHA-256: case, TaskID, first_seen. `allowed`: case, TaskID that may be chosen. A trace whose time can't be read makes no case."""
    named = traces.filter(F.trim(F.coalesce("TaskID", F.lit(""))) != "").withColumn("TaskID", F.trim("TaskID"))
    named = named if allowed is None else named.join(allowed.select(case, "TaskID").distinct(), [case, "TaskID"], "left_semi")
    best = named.groupBy(case).agg(F.min_by(F.struct("TaskID", "FirstSeen"), F.struct(F.sha2("TaskID", 256), "FirstSeen")).alias("t"))
    return best.select(case, F.col("t.TaskID").alias("TaskID"), F.try_to_timestamp("t.FirstSeen", F.lit("yyyy-MM-dd HH:mm:ss")).alias("first_seen")).filter("first_seen IS NOT NULL")


def trace_records(events: DataFrame, chosen: DataFrame, case: str) -> DataFrame:
    """case, ts, service, level, component, event_name, message, execution_id of the events of chosen traces; all of a trace have its first time, for clocks of hosts can't be compared."""
    name, description = _text(events, "OpName"), _text(events, "Description")
    rows = events.join(chosen, [case, "TaskID"])
    message = F.concat(name, F.lit(": "), description)
    level = F.when(F.rlike(message, F.lit(TRACE_FAILURE)), "error").otherwise("info")
    return rows.select(
        case, F.col("first_seen").alias("ts"), F.lit("hdfs").alias("service"), level.alias("level"), _text(events, "Agent").alias("component"), name.alias("event_name"),
        F.substring(redact_message(sanitize.public_message(message)), 1, MESSAGE_LIMIT).alias("message"), scoped_id("trace-", F.col("TaskID"), TRACE_DIGITS).alias("execution_id"))
