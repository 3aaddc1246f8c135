"""Parsers of raw log lines. Input: (file, line_no, line); output: records with the lines that belong to them.

A line that starts a record opens it; lines that don't belong to the record before them, and before any record
are orphans. Records are runs between openings: one running sum over a file's lines, then one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineFormat:
    """Header pattern with named parts in order, and the layout of its time text."""

    name: str
    header: str
    parts: tuple[str, ...]
    time_format: str
    time_parts: tuple[str, ...] = ("time",)


# Header patterns.
HDFS = LineFormat("hdfs", r"^(\d{6}) (\d{1,6}) (\d+) (\w+) ([^:]+): (.*)$", ("date", "clock", "pid", "level", "component", "body"), "yyMMddHHmmss", ("date", "clock"))
SPARK = LineFormat("spark", r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) (\w+) ([^:]+): (.*)$", ("time", "level", "component", "body"), "yy/MM/dd HH:mm:ss")
HADOOP = LineFormat("hadoop", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) (\w+) (?:\[([^\]]*)\] )?(.*)$", ("time", "millis", "level", "thread", "body"), "yyyy-MM-dd HH:mm:ss")
OPENSTACK = LineFormat("openstack", r"^(\S+) (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) (\d+) (\w+) (\S+) (.*)$", ("source", "time", "pid", "level", "component", "body"), "yyyy-MM-dd HH:mm:ss.SSS")
ZOOKEEPER = LineFormat("zookeeper", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\w+)\s+\[(.*):([^:@]+)@(\d+)\] - (.*)$", ("time", "level", "thread", "component", "at", "body"), "yyyy-MM-dd HH:mm:ss,SSS")
BGL = LineFormat("bgl", r"^(\S+)\s+(\d+)\s+(\d{4}\.\d{2}\.\d{2})\s+(\S+)\s+(\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*)$", ("truth", "epoch", "date", "node", "time", "node_again", "source", "component", "level", "body"), "yyyy-MM-dd-HH.mm.ss.SSSSSS")
EXCEPTION_LINES = [
    r"^Exception in thread \"[^\"]+\" (?:java\.lang\.Error:\s*)?(.*)$",
    r"^(?:[A-Za-z_][\w$]*\.)*[A-Za-z_][\w$]*(?:Exception|Error):\s*(.*)$",
]
#: Body text of a record that continuations are added up to.
BODY_LIMIT = 2000


def padded(part: str, column: Column) -> Column:
    return F.lpad(column, 6, "0") if part == "clock" else column


def parse(lines: DataFrame, form: LineFormat) -> DataFrame:
    """Records of a format: its parts, time, continuation count. Orphans have opening line null."""
    order = Window.partitionBy("file").orderBy("line_no")
    opens = F.rlike("line", F.lit(form.header))
    numbered = lines.withColumn("opens", opens).withColumn("record", F.sum(F.when(opens, 1).otherwise(0)).over(order))
    texts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    grouped = numbered.groupBy("file", "record").agg(
        F.min(F.when(F.col("opens"), F.col("line_no"))).alias("line_no"), F.max(F.when(F.col("opens"), F.col("line"))).alias("head"),
        F.count(F.lit(1)).alias("physical_lines"), F.array_join(F.transform(F.filter(texts, lambda x: ~F.rlike(x["line"], F.lit(form.header))), lambda x: x["line"]), "\n").alias("rest"),
    )
    parts = {p: F.regexp_extract("head", form.header, i + 1) for i, p in enumerate(form.parts)}
    stamp = F.concat(*[padded(p, parts[p]) for p in form.time_parts])
    body = F.when(F.col("rest") == "", parts["body"]).otherwise(F.substring(F.concat_ws("\n", parts["body"], F.col("rest")), 1, BODY_LIMIT))
    kept = [parts[p].alias(p) for p in form.parts if p not in (*form.time_parts, "body")]
    return grouped.filter("record > 0").select("file", "line_no", F.try_to_timestamp(stamp, F.lit(form.time_format)).alias("ts"), *kept, body.alias("message"), (F.col("physical_lines") - 1).alias("continuations"))


def accounting(lines: DataFrame, form: LineFormat) -> DataFrame:
    """physical = primary + continuation + orphan, by file."""
    opens = F.rlike("line", F.lit(form.header))
    order = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("opens", opens).withColumn("record", F.sum(F.when(opens, 1).otherwise(0)).over(order))
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("physical"), F.count_if("opens").alias("primary"), F.count_if(~F.col("opens") & (F.col("record") > 0)).alias("continuation"), F.count_if(F.col("record") == 0).alias("orphan"))


def parse_spark(lines: DataFrame) -> DataFrame:
    """Spark driver lines: an exception line after a record is a record of its own with the time before it; others are unparsed."""
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    timed = F.rlike("line", F.lit(SPARK.header))
    own = F.when(timed, F.try_to_timestamp(F.regexp_extract("line", SPARK.header, 1), F.lit(SPARK.time_format)))
    said = F.coalesce(*[F.when(F.rlike("line", F.lit(p)), F.regexp_extract("line", p, 1)) for p in EXCEPTION_LINES])
    failed = ~timed & F.col("said").isNotNull() & F.col("ts").isNotNull()
    rows = lines.withColumn("said", said).withColumn("ts", F.last(own, ignorenulls=True).over(order))
    return rows.select(
        "file", "line_no", F.when(timed, "record").when(failed, "exception").otherwise("unparsed").alias("kind"), F.when(timed | failed, F.col("ts")).alias("ts"),
        F.when(timed, F.regexp_extract("line", SPARK.header, 2)).when(failed, "ERROR").alias("level"),
        F.when(timed, F.regexp_extract("line", SPARK.header, 4)).when(failed, F.col("said")).otherwise(F.substring("line", 1, 300)).alias("message"),
    )


def block_events(records: DataFrame, selected: DataFrame) -> DataFrame:
    """One row for each block id that a message names and that is selected. `selected`: block."""
    found = records.withColumn("block", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"(blk_-?\d+)"), F.lit(1)))))
    return found.join(selected, "block", "left_semi")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; a file is read whole by one task so that its lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n"))).select("file", F.col("pos").cast("long").alias("line_no"), F.col("col").alias("line")).filter("line <> ''")
