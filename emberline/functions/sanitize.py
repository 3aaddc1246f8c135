"""Sanitizers of public log messages and small text heuristics, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import HIGH_SIGNAL_LEVELS, SECRETS, redact_message, with_rewritten
from emberline.storage import quoted

# ---------------------------------------------------------------------------------------------
# Patterns and their replacements.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PUBLIC = [
    (rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d.])", "[IP]"),
    (r"\bblk_-?\d+\b", "blk_[ID]"),
    (r"/user/[^/\s,]+", "/user/[USER]"),
]
SPARK = [
    (r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])", "[UUID]"),
    (r"\bapplication_\d+_\d+\b", "application_[ID]"),
    (r"(?i)\bmesos-slave-\d+\b", "mesos-slave-[ID]"),
    (r"(?<=/usercache/)[^/\s]+", "[USER]"),
    (r"(hdfs://(?:\[IP\]|[^/\s:]+)(?::\d+)?)/[^/\s]+", "$1/[USER]"),
    (r"Set\([^)]*\)", "Set([USER_SET])"),
    (r"(?id)(Changing (?:view|modify) acls to: ).*$", "$1[USER_SET]"),  # to the end of the text, not of a line
]
HADOOP = [
    (r"(?i)/tmp/hadoop-[^/\s,:]+", "/tmp/hadoop-[USER]"),
    (r"(?i)\bmsra-sa-\d+\b", "[HOST]"),
    *[(rf"(?i)\b{word}_\d+(?:_\d+)+\b", f"{word}_[ID]") for word in ("application", "container", "job", "attempt", "task")],
    (r"(?i)\bjob_\d+(?:_\d+)+(?=Job\b)", "job_[ID]"),
]
INSTANCE = [
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[UUID]"),
    (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", "[IP]"),
]
HIGH_SIGNAL = (
    r"(?i)(error|exception|fatal|panic|timeout|failed|failure|lost|unreachable|refused|exhausted|oomkilled|servfail|nxdomain|"
    r"no space left|disk full|connection reset|exit code|killed)"
)
CONFIDENCE = [
    r"(?i)Confidence\s*[:\-—]?\s*(High|Medium|Low)[^\d]{0,20}(\d{1,3})?",
    r"(?i)[\(\[]\s*(High|Medium|Low)(?:\s+confidence)?\s*[,;\-—]?\s*(?:~|approx\.?)?\s*(\d{1,3})?\s*%?\s*[\)\]]",
    r"(?i)\b(High|Medium|Low)\s+confidence[^\d]{0,20}(\d{1,3})?",
]
# End of fixed values.
# ---------------------------------------------------------------------------------------------


def _rewritten(message: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.coalesce(message, F.lit(""))
    for pattern, instead in rules:
        out = F.regexp_replace(out, pattern, instead)
    return out


def public_message(message: Column) -> Column:
    """Addresses, block ids and users' paths taken out."""
    return _rewritten(message, PUBLIC)


def spark_message(message: Column) -> Column:
    """A public message without the identifiers of a Spark run."""
    return _rewritten(public_message(message), SPARK)


def hadoop_message(message: Column) -> Column:
    """A public message without hosts, users and execution ids, redacted."""
    return redact_message(_rewritten(public_message(message), HADOOP))


def with_hadoop_message(df: DataFrame, name: str) -> DataFrame:
    """`df` with the column `name` as hadoop_message has it, in steps."""
    return with_rewritten(df.withColumn(name, F.coalesce(quoted(name), F.lit(""))), name, [*PUBLIC, *HADOOP, *SECRETS])


def instance_message(message: Column) -> Column:
    """UUIDs and addresses of any form taken out."""
    return _rewritten(message, INSTANCE)


def is_high_signal(level: Column, message: Column) -> Column:
    return F.lower(F.coalesce(level, F.lit(""))).isin(HIGH_SIGNAL_LEVELS) | F.rlike(F.coalesce(message, F.lit("")), F.lit(HIGH_SIGNAL))


def names_dependency(error_type: Column, signature: Column) -> Column:
    """Whether an error type or signature speaks of an upstream or a dependency."""
    said = F.lower(F.concat_ws(" ", F.coalesce(error_type, F.lit("")), F.coalesce(signature, F.lit(""))))
    return F.contains(said, F.lit("upstream")) | F.contains(said, F.lit("dependency"))


def shorten(value: Column, limit: int = 70) -> Column:
    """Text on one line, with three dots where it is cut."""
    line = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 3), F.lit("...")))


def stated_confidence(value: Column) -> Column:
    """struct<label, percent> of the first form of words that states a confidence; nulls without one, an empty percent where none is given."""
    found = F.lit(None).cast("struct<label:string,percent:string>")
    for pattern in reversed(CONFIDENCE):
        label = F.regexp_extract(value, pattern, 1)
        found = F.when(label != "", F.struct(F.initcap(F.lower(label)).alias("label"), F.regexp_extract(value, pattern, 2).alias("percent"))).otherwise(found)
    return found


def hour_cohort(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:'00Z'")


def first_by_precedence(values: Column, order: list[str]) -> Column:
    """The first of `order` that an array has."""
    return F.coalesce(*[F.when(F.array_contains(values, v), v) for v in order])


def json_bytes(value: Column) -> Column:
    """Size of a value as compact JSON in UTF-8."""
    return F.octet_length(F.to_json(value, {"ignoreNullFields": "false"}))
