"""Records of log files that are read in splits: lines that open no record belong to the record before them, in whatever split that began.

A file is read in byte ranges, in parallel. Each split is gone through once in the order of its lines, holding one open record: it gives the
records that begin in it, and one row of the lines before its first record. What these belong to is the last record of the nearest split
before, which a scan over one row a split tells; only last records and these rows are joined. No line is shuffled and no task holds a file.

Input: (file, split, line), the lines of a split one after the other in their order, each split in one partition, as `read_splits` gives them.
Blank lines belong to nothing and aren't counted. A record's text is cut at BODY_LIMIT characters, continuation lines included; its
continuation lines are counted in full. Lines before any record of a file are orphans. An empty file has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import sanitize
from emberline.functions.text import redact_message
from emberline.sources.raw_logs import BODY_LIMIT, LineFormat, padded
from emberline.storage import find_package, written

PIECES = "file string, split long, number long, head string, rest string, continuations long, last boolean"

# Identifiers in messages, and names of errors.
ERROR_TYPE = r"\b([A-Za-z_$][\w.$]*(?:Exception|Error))\b"
INSTANCE_ID = r"(?i)\[instance: ([0-9a-f-]{36})\]"
REQUEST_ID = r"(?i)\[(req-[0-9a-f-]{36})\b"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
ID_DIGITS = 12


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line) of text files; `split` is the byte at which the part of the file begins (spark.sql.files.maxPartitionBytes)."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("line"))


class _Open:
    """The record, or the lines before the first one, that a split is at."""

    def __init__(self, file: str, split: int) -> None:
        self.file, self.split, self.number = file, split, 0
        self.head: str | None = None
        self.rest: list[str] = []
        self.size = self.lines = 0

    def begin(self, head: str) -> None:
        self.number += 1
        self.head, self.rest, self.size, self.lines = head, [], 0, 0

    def add(self, lines: list[str]) -> None:
        self.lines += len(lines)
        for line in lines:
            if self.size >= BODY_LIMIT:
                break
            self.rest.append(line[:BODY_LIMIT])
            self.size += len(self.rest[-1]) + 1

    def row(self, last: bool) -> tuple:
        return self.file, self.split, self.number, self.head, "\n".join(self.rest)[:BODY_LIMIT], self.lines, last


def pieces(lines: DataFrame, form: LineFormat) -> DataFrame:
    """Per split: its records by number from 1, and under number 0 the lines before the first (if any); `last` marks the split's last row."""
    find_package(lines.sparkSession)
    header = form.header
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("number", pa.int64()), ("head", pa.string()), ("rest", pa.string()), ("continuations", pa.int64()), ("last", pa.bool_())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Open | None = None
        for batch in batches:
            if not len(batch):
                continue
            out: list[tuple] = []
            text = batch.column("line")
            opens = pc.match_substring_regex(text, header).to_numpy(zero_copy_only=False)
            splits = batch.column("split").to_numpy()
            files = batch.column("file").dictionary_encode()
            codes = files.indices.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (splits[1:] != splits[:-1]) | (codes[1:] != codes[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(batch)], strict=True):
                file, split = files.dictionary[int(codes[a])].as_py(), int(splits[a])
                if now is None or (now.file, now.split) != (file, split):
                    if now is not None:
                        out.append(now.row(True))
                    now = _Open(file, split)
                starts = a + np.flatnonzero(opens[a:b])
                texts = text.slice(a, b - a).to_pylist()
                now.add(texts[: (starts[0] if len(starts) else b) - a])
                bounds = np.r_[starts, b] - a
                for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                    if now.head is not None or now.lines:
                        out.append(now.row(False))
                    now.begin(texts[i])
                    now.add(texts[i + 1 : j])
            if out:
                yield batch_of(out)
        if now is not None:
            yield batch_of([now.row(True)])

    return lines.filter("line <> ''").mapInArrow(run, PIECES)


def assemble(lines: DataFrame, form: LineFormat) -> tuple[DataFrame, DataFrame]:
    """Records (file, split, number, head, rest, continuations) and accounting by file (physical, primary, continuation, orphan)."""
    found = written(pieces(lines, form), f"pieces-{form.name}")
    ends = found.filter("last").select("file", "split", F.when(F.col("number") > 0, F.struct("split", "number")).alias("open"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    holders = ends.select("file", "split", F.last("open", ignorenulls=True).over(before).alias("holder"))
    leads = found.filter("number = 0 AND continuations > 0").join(holders, ["file", "split"])
    sooner = Window.partitionBy("file", "holder").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    room = F.coalesce(F.sum(F.length("rest") + 1).over(sooner), F.lit(0)) < BODY_LIMIT  # what comes later can't show in the record
    held = leads.filter("holder IS NOT NULL").withColumn("piece", F.when(room, F.struct(F.col("split").alias("s"), "rest")))
    owned = held.groupBy("file", F.col("holder.split").alias("split"), F.col("holder.number").alias("number")).agg(
        F.sum("continuations").alias("more"), F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["rest"]), "\n").alias("tail")
    )
    closing = found.filter("last AND number > 0").drop("last").join(owned, ["file", "split", "number"], "left")
    joined = F.when(F.col("tail").isNull(), F.col("rest")).when(F.col("continuations") == 0, F.col("tail")).otherwise(F.concat_ws("\n", "rest", "tail"))
    closing = closing.select("file", "split", "number", "head", F.substring(joined, 1, BODY_LIMIT).alias("rest"), (F.col("continuations") + F.coalesce("more", F.lit(0))).alias("continuations"))
    records = found.filter("NOT last AND number > 0").drop("last").unionByName(closing)

    orphans = leads.filter("holder IS NULL").groupBy("file").agg(F.sum("continuations").alias("orphan"))
    counts = found.groupBy("file").agg(F.count_if(F.col("number") > 0).alias("primary"), F.sum("continuations").alias("others")).join(orphans, "file", "left")
    orphan = F.coalesce("orphan", F.lit(0)).alias("orphan")
    return records, counts.select("file", (F.col("primary") + F.col("others")).alias("physical"), "primary", (F.col("others") - orphan).alias("continuation"), orphan)


def parsed(records: DataFrame, form: LineFormat) -> DataFrame:
    """The format's parts of assembled records, time and message, as `raw_logs.parse` has them."""
    parts = {p: F.regexp_extract("head", form.header, i + 1) for i, p in enumerate(form.parts)}
    stamp = F.concat(*[padded(p, parts[p]) for p in form.time_parts])
    body = F.when(F.col("rest") == "", parts["body"]).otherwise(F.substring(F.concat_ws("\n", parts["body"], F.col("rest")), 1, BODY_LIMIT))
    kept = [parts[p].alias(p) for p in form.parts if p not in (*form.time_parts, "body")]
    return records.select("file", "split", "number", F.try_to_timestamp(stamp, F.lit(form.time_format)).alias("ts"), *kept, body.alias("message"), "continuations")


def scoped_id(kind: str, value: Column) -> Column:
    """`kind` and the first digits of the value's SHA-256; null stays."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(value, 256), 1, ID_DIGITS))


def hadoop_events(records: DataFrame, application: Column) -> DataFrame:
    """Component and message apart (by the first line), sanitized; the error's type; ids of application and container (the file's name) hashed."""
    container = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    cut = F.contains(F.substring_index("message", "\n", 1), F.lit(": "))
    rows = records.withColumn("component", F.when(cut, F.substring_index("message", ": ", 1)).otherwise("unknown"))
    message = F.when(cut, F.expr("substring(message, length(component) + 3)")).otherwise(F.col("message"))
    rows = sanitize.with_hadoop_message(rows.withColumn("message", message), "message")
    rows = rows.withColumn("message", F.substring("message", 1, BODY_LIMIT)).withColumn("level", F.lower("level"))
    named = F.contains("message", F.lit("Exception")) | F.contains("message", F.lit("Error"))
    rows = rows.withColumn("error_type", F.when(named, F.regexp_extract("message", ERROR_TYPE, 1)))
    return rows.select(*records.columns, "component", F.nullif("error_type", F.lit("")).alias("error_type"), scoped_id("workload", application).alias("workload_id"), scoped_id("execution", container).alias("execution_id"))


def openstack_events(records: DataFrame) -> DataFrame:
    """Service of the source, ids of instance and request hashed, and taken out of the message with addresses."""
    service = F.substring_index("source", ".", 1)
    first = F.substring_index("message", "\n", 1)
    own = lambda kind, pattern: scoped_id(kind, F.nullif(F.regexp_extract(first, pattern, 1), F.lit("")))
    message = F.regexp_replace(F.regexp_replace("message", UUID, "[UUID]"), ADDRESS, "[IP]")
    return records.withColumns({"service": service, "level": F.lower("level"), "entity_key": own("instance", INSTANCE_ID), "request_id": own("request", REQUEST_ID), "message": message}).drop("source", "pid")


def zookeeper_events(records: DataFrame) -> DataFrame:
    """Level in lower case, message public and redacted."""
    return records.withColumn("level", F.lower("level")).withColumn("message", F.substring(redact_message(sanitize.public_message(F.col("message"))), 1, BODY_LIMIT))
