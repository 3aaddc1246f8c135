"""Text functions on columns: fingerprints, redaction, pivots, codes, signals. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.literals import literals
from emberline.storage import quoted, unused

# ---------------------------------------------------------------------------------------------
# Patterns and names that results depend on.

#: Codes whose value carries meaning, so a fingerprint keeps it.
SEMANTIC_CODES = [
    (r"(?i)\bsqlstate\s*[\[\(:= ]\s*([0-9a-z]{5})\]?", "sqlstate"),
    (r"(?i)\b(?:http(?:\s+status)?|status(?:_code)?)[=:\s]+([1-5][0-9]{2})\b", "http_status"),
    (r"(?i)\b(?:errno|error_code)[=:\s\[]+([0-9a-z_-]{2,16})\]?", "error_code"),
]
#: Words one of which every code has in it, in lower case.
CODE_WORDS = ["sqlstate", "http", "status", "errno", "error_code"]
#: Volatile parts of a lower-cased message, in order, and what stands for them.
VOLATILE = [
    (r'trace[_-]?id[=:\s"]+[a-z0-9-]+', "trace_id=?"),
    (r'(?:req(?:uest)?[_-]?id|x-request-id)[=:\s"]+[a-z0-9-]+', "request_id=?"),
    (r'user[_-]?id[=:\s"]+[a-z0-9-]+', "user_id=?"),
    (r"^\[(?:req-\[uuid\]|-)[^\]]*\]\s*", "[request_context] "),
    (r"\b(peer|host|node|pod|instance|container)(?:[_-]?id)?[=:]+[a-z0-9._-]+", "$1=?"),
    (r"\b0x[0-9a-f]+\b", "<hex>"),
    (
        r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun)\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+"
        r"\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\b",
        "<timestamp>",
    ),
    (r"\b(?=[0-9a-f]{7,40}\b)(?=[0-9a-f]*[a-f])[0-9a-f]+\b", "<hex>"),
    (r"(?<![a-z0-9])[-+]?\d+(?:\.\d+)?\s*(?:bytes?|[kmgt]?i?b|milliseconds?|ms|seconds?|secs?)\b", "<measure>"),
    (r"[-+]?\d+(?:\.\d+)?", "<num>"),
    (r"(?:blk_\[(?:id|ID)\](?:\s+|$))+", "blk_[id] "),
    (r"\s+", " "),
]
#: The same for shapes that the sampler compares: no measures, times or blocks, numbers without sign, UUIDs.
SAMPLED_VOLATILE = [
    *VOLATILE[:6],
    (r"\b[0-9a-f]{8}-[0-9a-f-]{27,}\b", "<uuid>"),
    VOLATILE[7],
    (r"\d+(?:\.\d+)?", "<num>"),
    VOLATILE[11],
]
FINGERPRINT_LENGTH, HEAD, TAIL = 180, 120, 56
MAX_CODES = 26

#: Secrets and identifying values in free text, in order.
SECRETS = [
    (r"(?i)(authorization|api[_-]?key|token|password|secret)\s*[=:]\s*['\"]?[^\s,'\"]+", "$1=[REDACTED]"),
    (r"(?i)bearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[OPENAI_KEY_REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}\b", "[GITHUB_TOKEN_REDACTED]"),
    (r"(?i)\bxox[a-z]-[A-Za-z0-9-]{16,}\b", "[SLACK_TOKEN_REDACTED]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b(?:\d[ -]*?){13,19}\b", "[CARD_REDACTED]"),
    (r"(?i)\b(user|ruser|logname|account|acct)\s*=\s*[^\s,;]+", "$1=[USER_REDACTED]"),
    (r"(?i)\b(rhost|remote_host|hostname|host)\s*=\s*[^\s,;]+", "$1=[HOST_REDACTED]"),
    (r"(?i)(\bfrom\s+(?:\[IP\]|(?:\d{1,3}\.){3}\d{1,3})\s*)\([^)]*\)", "$1([HOST_REDACTED])"),
    (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", "[IP_REDACTED]"),
]
MARKERS = [
    "[REDACTED]", "[OPENAI_KEY_REDACTED]", "[GITHUB_TOKEN_REDACTED]", "[SLACK_TOKEN_REDACTED]", "[EMAIL_REDACTED]",
    "[CARD_REDACTED]", "[USER_REDACTED]", "[HOST_REDACTED]", "[IP_REDACTED]",
]
SENSITIVE_LABELS = [
    "authorization", "api_key", "apikey", "token", "password", "secret", "email", "user_email", "customer_email", "user_id", "customer_id",
]
SENSITIVE_FRAGMENTS = ["authorization", "api_key", "apikey", "token", "password", "secret", "email", "user_id", "customer_id"]

PIVOTS = {
    "trace_id": r'(?i)trace[_-]?id[=:\s"]+([a-f0-9-]{8,})',
    "request_id": r'(?i)(?:req(?:uest)?[_-]?id|x-request-id)[=:\s"]+([A-Za-z0-9-]{6,})',
    "user_id": r'(?i)user[_-]?id[=:\s"]+([A-Za-z0-9-]{3,})',
    "commit_sha": r"\b([0-9a-f]{7,40})\b",
}

#: pattern, label, code -> meaning
CODES = [
    (r"HTTP\s+(\d{3})", "HTTP", {
        "429": "Too Many Requests — rate limited", "500": "Internal Server Error", "502": "Bad Gateway — upstream failed",
        "503": "Service Unavailable — capacity or dep down", "504": "Gateway Timeout — upstream slow",
    }),
    (r"exit code[:\s]+(\d+)", "k8s exit", {
        "1": "Generic app error", "137": "OOMKilled (SIGKILL by kernel, usually memory)", "139": "Segmentation fault",
        "143": "SIGTERM (graceful shutdown)",
    }),
    (r"SQLSTATE[\[(]([0-9A-Z]{5})[\])]", "Postgres", {
        "08006": "connection failure", "23505": "unique constraint violation", "40001": "serialization failure — retry candidate",
        "40P01": "deadlock detected", "53300": "too many connections", "57014": "query canceled — timeout",
    }),
    (r"ERROR (\d{4})", "MySQL", {
        "1040": "too many connections", "1213": "deadlock detected", "2006": "server has gone away", "2013": "lost connection during query",
    }),
]

LEVEL_SYNONYMS = {
    "error": ["error", "err", "fatal", "crit", "critical"], "warn": ["warn", "warning"], "info": ["info", "information", "notice"],
    "debug": ["debug", "trace", "verbose"],
}

#: rule, family, directness, status, scope, pattern
SIGNALS = [
    ("job-state-succeeded", "job_lifecycle", "direct", "succeeded", "job", r"(?i)(?:(?:\bjob(?:_[^\s]+)?(?:job)?).{0,8}transitioned\s+from.{0,80}\s+to\s+succeeded|\bjob\b.{0,40}(?:final\s+status.{0,20}succeeded|completed\s+successfully))"),
    ("job-state-failed", "job_lifecycle", "direct", "failed", "job", r"(?i)(?:(?:\bjob(?:_[^\s]+)?(?:job)?).{0,8}transitioned\s+from.{0,80}\s+to\s+(?:failed|killed)|\bjob\b.{0,40}(?:final\s+status.{0,20}(?:failed|killed)|failed))"),
    ("job-finished-event", "job_lifecycle", "indirect", "finished_event", "job", r"(?i)(?:JobFinishedEvent|\bJOB_FINISHED\b)"),
    ("machine-lost-node", "machine_availability", "direct", "unavailable", "node", r"(?i)(?:released\s+on\s+a\s+\*?lost\*?\s+node|(?:node|worker|host).{0,40}(?:unavailable|\blost\b|\bdown\b)|(?:unavailable|\blost\b|\bdown\b).{0,40}(?:node|worker|host))"),
    ("network-no-route", "network_transport", "direct", "unreachable", "network_peer", r"(?i)(?:NoRouteToHost(?:Exception)?|no\s+route\s+to\s+host|network\s+is\s+unreachable)"),
    ("network-disconnect", "network_transport", "direct", "disconnected", "network_peer", r"(?i)(?:connection\s+(?:reset|refused|timed\s*out)|network\s+disconnect(?:ed|ion)?|unreachable\s+peer)"),
    ("network-latency", "network_transport", "indirect", "slow", "transport", r"(?i)(?:slow\s+(?:read|write|connection)|socket\s+timeout)"),
    ("storage-capacity", "storage_capacity", "direct", "exhausted", "storage", r"(?i)(?:no\s+space\s+left(?:\s+on\s+device)?|\bdisk\s+full\b|\bENOSPC\b|quota\s+exceeded|storage\s+capacity.{0,30}exhaust)"),
    ("storage-read-only", "storage_write", "direct", "write_blocked", "storage", r"(?i)(?:read-only\s+file\s+system|write\s+failed.{0,40}(?:space|capacity))"),
    ("storage-stream-read-failed", "storage_io", "direct", "read_failed", "storage_block", r"(?i)(?:could\s+not\s+read\s+from\s+stream|failed\s+to\s+read\s+from\s+stream)"),
    ("storage-block-metadata-inconsistent", "storage_metadata", "direct", "inconsistent", "storage_block", r"(?i)(?:blockinfo\s+not\s+found\s+in\s+volumemap|block.{0,60}does\s+not\s+belong\s+to\s+any\s+file)"),
    ("storage-block-serve-exception", "storage_io", "indirect", "serve_exception", "storage_block", r"(?i)got\s+exception\s+while\s+serving\s+(?:block|blk_)"),
    ("storage-block-operation-failed", "storage_io", "direct", "block_operation_failed", "storage_block", r"(?i)(?:OP_READ_BLOCK|OP_STATUS_ERROR|could\s+not\s+(?:create\s+)?BlockSender|no\s+live\s+nodes\s+contain\s+current\s+block|could\s+not\s+obtain\s+block)"),
    ("storage-integrity-corruption", "storage_integrity", "direct", "corruption_detected", "storage", r"(?i)(?:checksum\s+error|corrupt(?:ed|ion)?.{0,40}(?:block|segment)|(?:block|segment).{0,40}corrupt(?:ed|ion)?)"),
    ("storage-mount-failed", "storage_availability", "direct", "mount_failed", "storage", r"(?i)(?:(?:lustre|filesystem|file\s+system|volume).{0,50}\bmount\s+failed\b|\bmount\s+failed\b)"),
    ("connection-broken", "network_transport", "direct", "interrupted", "network_peer", r"(?i)\bconnection\s+broken\b"),
    ("connection-stream-ended", "connection_lifecycle", "direct", "stream_ended", "connection", r"(?i)(?:caught\s+end\s+of\s+stream\s+exception|unexpected\s+end\s+of\s+stream)"),
    ("machine-hardware-fault", "machine_hardware", "direct", "fault_observed", "node", r"(?i)(?:machine\s+check\s+interrupt|(?:instruction|data|l[123]).{0,30}(?:cache|unit)?.{0,30}parity\s+error|\bhardware\s+(?:fault|error)\b)"),
    ("process-failure", "process_failure", "direct", "terminated", "process", r"(?i)(?:segmentation\s+fault|\bsegfault\b|kernel\s+panic|fatal\s+signal|process.{0,40}(?:terminated\s+unexpectedly|\bkilled\b))"),
    ("workload-state-succeeded", "workload_lifecycle", "direct", "succeeded", "workload", r"(?i)(?:instance\s+spawned\s+successfully|claim\s+successful)"),
    ("workload-state-resumed", "workload_lifecycle", "direct", "resumed", "workload", r"(?i)\bVM\s+Resumed\s+\(Lifecycle\s+Event\)"),
    ("workload-state-paused", "workload_lifecycle", "direct", "paused", "workload", r"(?i)\bVM\s+Paused\s+\(Lifecycle\s+Event\)"),
]
#: First match wins.
OPERATION_EFFECTS = [
    ("execution_disrupted", r"(?i)container\s+released\s+on\s+a\s+\*?lost\*?\s+node"),
    ("block_operation_failed", r"(?i)(?:could\s+not\s+read\s+from\s+stream|failed\s+to\s+read\s+from\s+stream|OP_READ_BLOCK|OP_STATUS_ERROR|could\s+not\s+(?:create\s+)?BlockSender|no\s+live\s+nodes\s+contain\s+current\s+block|could\s+not\s+obtain\s+block|checksum\s+error)"),
    ("operation_failed", r"(?i)(?:failed\s+to\s+(?:connect|renew|read|write)|add\s+to\s+deadnodes|write\s+failed)"),
]
HIGH_SIGNAL_LEVELS = ["error", "fatal", "warn", "warning", "critical"]
# End of fixed values.
# ---------------------------------------------------------------------------------------------


def _rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def _has_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in sorted(words)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def fixed(value: Column) -> Column:
    """`value` as a column that the planner never puts in place of its name: one element of an array that is unnested.

    A filter or join key over a column is otherwise rewritten down to the columns that it is made of, and where each step reads the one before several times
    that expression grows as a power of the steps, until it fills the driver. Filters on other columns still pass.
    """
    return F.explode(F.array(value))


def _protect(label: str) -> Callable[[Column, Column], Column]:
    """Step that swaps one match for a token and keeps its value."""

    def step(s: Column, p: Column) -> Column:
        token = F.concat(F.lit("__semanticcode"), F.chr(F.lit(97) + F.size(s["codes"])), F.lit("__"))
        at = F.instr(s["text"], p["whole"])
        swapped = F.concat(F.substring(s["text"], F.lit(1), at - 1), token, F.substring(s["text"], at + F.length(p["whole"]), F.length(s["text"])))
        one = F.struct(token.alias("token"), F.concat(F.lit(f"{label}="), p["code"]).alias("value"))
        full = F.size(s["codes"]) >= MAX_CODES
        return F.struct(
            F.when(full, s["text"]).otherwise(swapped).alias("text"), F.when(full, s["codes"]).otherwise(F.concat(s["codes"], F.array(one))).alias("codes")
        )

    return step


def _protect_all(state: Column, pattern: str, label: str) -> Column:
    def apply(s: Column) -> Column:
        found = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0))
        codes = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(1))
        return F.aggregate(F.arrays_zip(found.alias("whole"), codes.alias("code")), s, _protect(label))

    return let(state, apply)


def fingerprint(message: Column) -> Column:
    """Shape of a message: volatile parts replaced, semantic codes kept, long shapes cut in the middle.

    Codes are taken out as array elements first and put back last, so the number rules don't see them; a
    token ends in a letter and has underscores round it, so word rules don't either.
    """
    return _shape(message, VOLATILE)


def sampling_shape(message: Column, labels: list[Column], level: Column) -> Column:
    """What the sampler takes for one kind of record: service and other labels, level in lower case, and the message's shape, as one text."""
    first, *others = [F.coalesce(c.cast("string"), F.lit("")) for c in labels]
    return F.concat_ws("\x1f", first, F.lower(F.coalesce(level, F.lit(""))), *others, _shape(message, SAMPLED_VOLATILE))


def _shape(message: Column, rules: list[tuple[str, str]]) -> Column:
    return let(_shape_of_many(F.lower(F.coalesce(message, F.lit(""))), rules), _cut)


def _shape_of_many(lowered: Column, rules: list[tuple[str, str]]) -> Column:
    """The shape before it is cut, of a text with any number of codes."""
    taken = F.array().cast("array<struct<token:string,value:string>>")
    state = F.struct(lowered.alias("text"), taken.alias("codes"))
    for pattern, label in SEMANTIC_CODES:
        state = _protect_all(state, pattern, label)
    return let(state, lambda s: F.aggregate(s["codes"], F.trim(_rewrite(s["text"], rules)), lambda t, c: F.replace(t, c["token"], c["value"])))


def _cut(shape: Column) -> Column:
    return F.when(F.length(shape) <= FINGERPRINT_LENGTH, shape).otherwise(
        F.concat(F.substring(shape, 1, HEAD), F.lit(" … "), F.substring(shape, -TAIL, TAIL))
    )


def with_fingerprint(df: DataFrame, name: str, message: str) -> DataFrame:
    """`df` with the fingerprint of the column `message`, in steps of plain columns, each of which is computed once a row.

    A text with one word of CODE_WORDS at most has one code at most, so that plain replacements do; others go through their matches one by one.
    An expression is tried only where the text has a literal that every match has.
    """
    lowered, words, code, work = (unused(df, c) for c in ("lowered", "words", "code", "work"))
    token = F.lit("__semanticcodea__")
    rows = df.withColumn(lowered, F.lower(F.coalesce(quoted(message), F.lit(""))))
    rows = rows.withColumn(words, F.when(_has_any(F.col(lowered), CODE_WORDS), F.regexp_count(lowered, F.lit("|".join(CODE_WORDS)))).otherwise(0))
    one = F.col(words) == 1
    found = [F.when(one, F.regexp_extract(lowered, pattern, 1)).alias(label) for pattern, label in SEMANTIC_CODES]
    rows = rows.withColumn(code, F.struct(*found))
    values = [F.when(F.col(code)[label] != "", F.concat(F.lit(f"{label}="), F.col(code)[label])) for _, label in SEMANTIC_CODES]
    rows = rows.withColumn(code, F.coalesce(*values))
    taken = reduce(lambda t, c: F.regexp_replace(t, F.lit(c[0]), token), SEMANTIC_CODES, F.col(lowered))
    rows = rows.withColumn(work, F.when(F.col(code).isNull(), F.col(lowered)).otherwise(taken))
    for pattern, instead in VOLATILE:
        known = literals(pattern)
        replaced = F.regexp_replace(work, pattern, instead)
        rows = rows.withColumn(work, F.when(_has_any(F.col(work), known), replaced).otherwise(F.col(work)) if known else replaced)
    rows = rows.withColumn(work, F.trim(work))
    rows = rows.withColumn(work, F.when(F.col(code).isNull(), F.col(work)).otherwise(F.replace(F.col(work), token, F.col(code))))
    rows = rows.withColumn(work, F.when(F.col(words) <= 1, F.col(work)).otherwise(_shape_of_many(F.col(lowered), VOLATILE)))
    return rows.select(*[quoted(c) for c in df.columns], fixed(_cut(F.col(work))).alias(name))


def with_rewritten(df: DataFrame, name: str, rules: list[tuple[str, str]]) -> DataFrame:
    """`df` with the column `name` rewritten by the rules in order, in steps, each of which is computed once a row.

    An expression is tried only where the text has a literal that every match has.
    """
    text = quoted(name)
    for pattern, instead in rules:
        known = literals(pattern, 1)
        replaced = F.regexp_replace(text, pattern, instead)
        df = df.withColumn(name, F.when(_has_any(F.lower(text), known), replaced).otherwise(text) if known else replaced)
    return df.withColumn(name, fixed(text))


def redact_message(message: Column) -> Column:
    return _rewrite(F.coalesce(message, F.lit("")), SECRETS)


def pseudonym(value: Column, salt: str = "") -> Column:
    """Stable stand-in for a sensitive value; one that is already redacted stays."""
    known = F.startswith(value, F.lit("redacted-")) | value.isin(MARKERS)
    return F.when(known, value).otherwise(scoped_id("redacted-", F.concat(F.lit(f"{salt}:"), F.coalesce(value, F.lit("None"))), 12))


def scoped_id(prefix: str, value: Column, digits: int = 12) -> Column:
    """prefix and the first hex digits of the value's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, digits))


def is_sensitive(key: Column) -> Column:
    lowered = F.lower(key)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(x)) for x in SENSITIVE_FRAGMENTS], lowered.isin(SENSITIVE_LABELS))


def redact_labels(labels: Column, salt: str = "") -> Column:
    """Values of sensitive label names by pseudonyms; others stay."""
    return F.transform_values(labels, lambda k, v: F.when(F.lower(k).isin(SENSITIVE_LABELS), pseudonym(v, salt)).otherwise(v))


def redact_data(values: Column, salt: str = "") -> Column:
    """A map of strings: values under sensitive keys by pseudonyms, the others as free text."""
    return F.transform_values(values, lambda k, v: F.when(is_sensitive(k), pseudonym(v, salt)).otherwise(redact_message(v)))


def pivots(message: Column, name: str) -> Column:
    """Distinct pivot values of one field in a message, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(message, F.lit(PIVOTS[name]), F.lit(1)))


def decode_codes(message: Column) -> Column:
    """array<struct<label, code, meaning>> of the codes with a known meaning; the first of each pattern."""
    found = []
    for pattern, label, meanings in CODES:
        code = F.regexp_extract(message, pattern, 1)
        table = F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])
        found.append(F.struct(F.lit(label).alias("label"), code.alias("code"), F.try_element_at(table, code).alias("meaning")))
    return F.filter(F.array(*found), lambda c: c["meaning"].isNotNull())


def decorate(message: Column) -> Column:
    hits = decode_codes(message)
    notes = F.array_join(F.transform(hits, lambda h: F.concat(F.lit("["), h["label"], F.lit(" "), h["code"], F.lit(": "), h["meaning"], F.lit("]"))), " ")
    return F.when(F.size(hits) > 0, F.concat(message, F.lit("  "), notes)).otherwise(message)


def normalize_level(level: Column) -> Column:
    """Synonyms to error, warn, info, debug; others pass through lower-cased."""
    cleaned = F.lower(F.trim(level))
    return reduce(lambda other, item: F.when(cleaned.isin(item[1]), item[0]).otherwise(other), reversed(LEVEL_SYNONYMS.items()), cleaned)


def detect_signals(message: Column, level: Column | None = None) -> Column:
    """array<struct<rule_id, signal_family, directness, status, scope, match_method>> of observable matches."""

    def one(rule: str, family: str, directness: str, status: str, scope: str, method: str) -> Column:
        values = {"rule_id": rule, "signal_family": family, "directness": directness, "status": status, "scope": scope, "match_method": method}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    def hit(text: Column, lowered: Column, pattern: str) -> Column:
        known = literals(pattern)
        found = F.rlike(text, F.lit(pattern))
        return _has_any(lowered, known) & found if known else found

    def of(t: Column) -> Column:
        return F.filter(F.array(*[F.when(hit(t["text"], t["lowered"], p), one(r, f, d, s, c, "versioned_regex")) for r, f, d, s, c, p in SIGNALS]), lambda x: x.isNotNull())

    text = F.coalesce(message, F.lit(""))
    matched = let(F.struct(text.alias("text"), F.lower(text).alias("lowered")), of)
    if level is None:
        return matched
    fallback = F.array(one("source-level-unclassified-error", "unclassified_error", "direct", "error_logged", "service", "structured_source_level"))
    return let(matched, lambda m: F.when(F.lower(level).isin("error", "fatal", "critical") & (F.size(m) == 0), fallback).otherwise(m))


def operation_effect(message: Column) -> Column:
    return reduce(lambda other, rule: F.when(F.rlike(message, F.lit(rule[1])), rule[0]).otherwise(other), reversed(OPERATION_EFFECTS), F.lit(None).cast("string"))


def canonical(*parts: Column) -> Column:
    """Canonical text of a record: parts in the given order, nulls as empty, joined by the unit separator."""
    return F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def ascii_json(json: Column) -> Column:
    """JSON with every character beyond ASCII as \\u and four hex digits (two of them beyond U+FFFF)."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        high = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(high)

    plain = F.octet_length(json) == F.char_length(json)
    return F.when(plain, json).otherwise(F.array_join(F.transform(F.split(json, ""), one), ""))


def canonical_json(value: Column) -> Column:
    """A struct with its fields in alphabetical order, or a map from sorted_map, as compact JSON in ASCII; nulls are written."""
    return ascii_json(F.to_json(value, {"ignoreNullFields": "false"}))


def sorted_map(values: Column) -> Column:
    """The entries of a map that are not null, by key."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(values, lambda k, v: v.isNotNull()))))


def action_class(text: Column) -> Column:
    """read_only, execution_claim, proposal or unknown by precedence of wording."""
    claims = r"(?i)\b(?:restarted|rolled back|deployed|deleted|scaled|patched|executed)\b"
    reads = r"(?i)^\s*(?:check|inspect|query|compare|review|confirm|verify|read|list|look)\b"
    proposes = r"(?i)\b(?:restart|roll ?back|deploy|delete|scale|patch|disable|enable|increase|reduce|drain)\b"
    return F.when(F.rlike(text, F.lit(claims)), "execution_claim").when(F.rlike(text, F.lit(reads)), "read_only").when(
        F.rlike(text, F.lit(proposes)), "proposal").otherwise("unknown")
