"""Queries over evidence packs, contexts, stage retention, nested redaction and objects in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import nested, sanitize, text
from emberline.operators import grounding, packs, sampling
from emberline.plans.evidence_queries import kept_groups
from emberline.plans.log_queries import DETECTED, SIGNALLED, detected, with_groups
from emberline.sources.relations import deploys, duck, logs, read
from emberline.storage import written
from emberline.streaming import revisions

SECTIONS = {"Top Detection Rules": 2, "Log Groups": 8, "Deployments": 2}
PACK_BYTES = 900


def pack_lines(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    rules = detected(spark, sf_dir, found).select(
        "incident", F.lit("Top Detection Rules").alias("section"), (-F.col("rule_rank") * 1_000_000 - F.col("n")).cast("long").alias("place"), "event_id",
        F.concat(F.lit("- rule="), "rule_id", F.lit("; event="), "event_id", F.lit("; count="), F.col("n").cast("string")).alias("text"))
    groups = found.select(
        "incident", F.lit("Log Groups").alias("section"), (-F.col("n")).alias("place"), "event_id",
        F.concat(F.lit("- "), "event_id", F.lit("; service="), "service", F.lit("; level="), "level", F.lit("; count="), F.col("n").cast("string"), F.lit("; "), sanitize.shorten(F.col("example_message"))).alias("text"))
    changes = deploys(spark, sf_dir).select(
        F.date_format("deployed_at", "yyyy-MM-dd").alias("incident"), F.lit("Deployments").alias("section"), (-F.unix_micros("deployed_at")).alias("place"), F.concat(F.lit("dep-"), F.col("deploy_id").cast("string")).alias("event_id"),
        F.concat(F.lit("- deploy="), "commit", F.lit("; service="), "service").alias("text"))
    return rules.unionByName(groups).unionByName(changes)


def q_evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.packs(packs.chosen_lines(pack_lines(spark, sf_dir, kept_groups(spark, sf_dir)), SECTIONS, PACK_BYTES))


_SHORT = "CASE WHEN length(m) <= 70 THEN m ELSE substr(m, 1, 67) || '...' END"
_LINES = DETECTED + f""", lines AS (SELECT incident, 'Top Detection Rules' AS section, 0 AS o, 2 AS keep, CAST(-rule_rank * 1000000 - n AS BIGINT) AS place, event_id, '- rule=' || rule_id || '; event=' || event_id || '; count=' || n AS line FROM detected
  UNION ALL SELECT incident, 'Log Groups', 1, 8, -n, event_id, '- ' || event_id || '; service=' || service || '; level=' || level || '; count=' || n || '; ' || {_SHORT} FROM (SELECT *, trim(regexp_replace(example_message, '\\s+', ' ', 'g')) AS m FROM grouped)
  UNION ALL SELECT strftime(deployed_at, '%Y-%m-%d'), 'Deployments', 2, 2, -epoch_us(deployed_at), 'dep-' || deploy_id, '- deploy=' || commit || '; service=' || service FROM deploys),
  ranked_lines AS (SELECT *, row_number() OVER (PARTITION BY incident, section ORDER BY place, event_id, line) AS i FROM lines),
  sized AS (SELECT *, sum(strlen(line) + 1 + CASE WHEN i = 1 THEN strlen(section) + 4 ELSE 0 END) OVER (PARTITION BY incident ORDER BY o, i) AS total FROM ranked_lines WHERE i <= keep),
  fates AS (SELECT incident, o, i, section, line, event_id, total, CASE WHEN total <= {PACK_BYTES} THEN 'kept' ELSE 'bytes' END AS fate FROM sized UNION ALL SELECT incident, o, i, section, line, event_id, NULL, 'rows' FROM ranked_lines WHERE i > keep)"""
D_PACKS = with_groups("""SELECT incident, coalesce(string_agg(CASE WHEN i = 1 THEN '## ' || section || chr(10) ELSE '' END || line || chr(10), '' ORDER BY o, i) FILTER (fate = 'kept'), '') AS pack,
    CAST(coalesce(max(total) FILTER (fate = 'kept'), 0) AS INTEGER) AS bytes, count(*) FILTER (fate = 'kept') AS lines, count(*) FILTER (fate = 'rows') AS over_rows, count(*) FILTER (fate = 'bytes') AS over_bytes FROM fates GROUP BY incident""", _LINES)


def q_stage_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal families of each day in its records, a sample of these, the sample's groups with many records, and its pack."""
    rows = logs(spark, sf_dir).withColumn("incident", F.date_format("ts", "yyyy-MM-dd"))
    signals = lambda df, at="ts": df.select("incident", F.explode(F.array_distinct(F.transform(text.detect_signals(F.col("message"), F.col("level")), lambda s: s["signal_family"]))).alias("signal"), F.col(at).alias("at"))
    sample = sampling.lowest_hash(rows, "incident", "ordinal", 100).drop("digest", "rank")
    found = kept_groups(spark, sf_dir)
    groups = found.withColumnRenamed("example_message", "message")
    kept = packs.chosen_lines(pack_lines(spark, sf_dir, found), SECTIONS, PACK_BYTES).filter("fate = 'kept' AND section = 'Log Groups'").select("incident", "event_id")
    packed = groups.join(written(kept, "kept-lines"), ["incident", "event_id"], "left_semi")
    out = packs.stage_retention([("raw", signals(rows)), ("sample", signals(sample)), ("group", signals(groups.filter("n >= 3"), "first_seen")), ("pack", signals(packed, "first_seen"))])
    return out.withColumn("dropped", F.array_join("dropped", ","))


_FAMILY = "SELECT incident, signal, {at} AS seen, {i} AS stage FROM (SELECT incident, {at}, unnest(list_distinct(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(message, '{p}') THEN '{f}' END" for _, f, _, _, _, p in text.SIGNALS) + ", CASE WHEN level = 'error' AND NOT (" + " OR ".join(f"regexp_matches(message, '{p}')" for *_, p in text.SIGNALS) + ") THEN 'unclassified_error' END], lambda x: x IS NOT NULL))) AS signal FROM {rows})"
_STAGES = ["raw", "sample", "group", "pack"]
D_RETENTION = with_groups("""SELECT incident, stage, signals, retained, dropped, CASE WHEN whole = 0 THEN CASE WHEN signals > 0 THEN 1.0 ELSE 0.0 END ELSE round(least(own / whole, 1.0), 4) END AS span_ratio FROM (""" + " UNION ALL ".join(
    f"""SELECT incident, '{name}' AS stage, count(*) FILTER (s{i}) AS signals, count(*) FILTER (s{i} AND s0) AS retained, coalesce(string_agg(signal, ',' ORDER BY signal) FILTER (s0 AND NOT s{i}), '') AS dropped,
    coalesce(epoch_us(max(z{i})) - epoch_us(min(a{i})), 0) AS own, coalesce(epoch_us(max(z0)) - epoch_us(min(a0)), 0) AS whole FROM flags GROUP BY incident""" for i, name in enumerate(_STAGES)) + ")",
    f"""{_LINES}, dated AS (SELECT *, strftime(ts, '%Y-%m-%d') AS incident FROM logs),
  sampled AS (SELECT * FROM dated QUALIFY row_number() OVER (PARTITION BY incident ORDER BY sha256(incident || '|' || ordinal), ordinal) <= 100),
  grouped_many AS (SELECT *, example_message AS message FROM grouped WHERE n >= 3),
  packed AS (SELECT *, example_message AS message FROM grouped WHERE (incident, event_id) IN (SELECT incident, event_id FROM fates WHERE fate = 'kept' AND section = 'Log Groups')),
  seen AS ({" UNION ALL ".join(_FAMILY.replace("{at}", at).replace("{i}", str(i)).replace("{rows}", rows) for i, (rows, at) in enumerate((("dated", "ts"), ("sampled", "ts"), ("grouped_many", "first_seen"), ("packed", "first_seen"))))}),
  flags AS (SELECT incident, signal, {", ".join(f"bool_or(stage = {i}) AS s{i}, min(seen) FILTER (stage = {i}) AS a{i}, max(seen) FILTER (stage = {i}) AS z{i}" for i in range(4))} FROM seen GROUP BY ALL)""")


def q_decision_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each day's context: most frequent groups, first events, last deployments, detections by rank."""
    found = kept_groups(spark, sf_dir)
    changes = deploys(spark, sf_dir).select(F.date_format("deployed_at", "yyyy-MM-dd").alias("incident"), "deploy_id", "commit", "deployed_at")
    parts = packs.top_parts({
        "groups": (found.select("incident", "event_id", "service", "n"), [F.desc("n"), F.col("event_id")], 5),
        "timeline": (found.select("incident", "event_id", "first_seen"), [F.col("first_seen"), F.col("event_id")], 5),
        "deploys": (changes, [F.desc("deployed_at"), F.desc("deploy_id")], 2),
        "detections": (detected(spark, sf_dir, found).select("incident", "event_id", "rule_id", "rule_rank", "n"), [F.desc("rule_rank"), F.desc("n"), F.col("event_id"), F.col("rule_id")], 3),
    })
    return parts.select("incident", "part", "rank", F.coalesce(F.get_json_object("value", "$.event_id"), F.concat(F.lit("dep-"), F.get_json_object("value", "$.deploy_id"))).alias("id"))


D_PARTS = with_groups("""SELECT incident, 'groups' AS part, row_number() OVER (PARTITION BY incident ORDER BY n DESC, event_id) AS rank, event_id AS id FROM grouped QUALIFY rank <= 5
  UNION ALL SELECT incident, 'timeline', row_number() OVER (PARTITION BY incident ORDER BY first_seen, event_id) AS rank, event_id FROM grouped QUALIFY rank <= 5
  UNION ALL SELECT strftime(deployed_at, '%Y-%m-%d') AS incident, 'deploys', row_number() OVER (PARTITION BY strftime(deployed_at, '%Y-%m-%d') ORDER BY deployed_at DESC, deploy_id DESC) AS rank, 'dep-' || deploy_id FROM deploys QUALIFY rank <= 2
  UNION ALL SELECT incident, 'detections', row_number() OVER (PARTITION BY incident ORDER BY rule_rank DESC, n DESC, event_id, rule_id) AS rank, event_id FROM detected QUALIFY rank <= 3""", DETECTED)


def q_nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as nested values, three levels deep."""
    record = F.struct("user_id", "message", F.array(F.struct(F.col("trace_id").alias("auth_token"), F.create_map(F.lit("customer_email"), F.col("pod"), F.lit("path"), F.concat(F.lit("from 10.1.2.3 at "), "host")).alias("labels"))).alias("calls"))
    rows = nested.redact_columns(logs(spark, sf_dir).select("ordinal", record.alias("r")), ["r"])
    call = F.col("r.calls")[0]
    return rows.select("ordinal", F.col("r.user_id").alias("user_id"), F.contains("r.message", F.lit("token=[REDACTED]")).alias("hidden"), call["auth_token"].alias("token"), call["labels"]["customer_email"].alias("email"), call["labels"]["path"].alias("path"))


_P = "'redacted-' || substr(sha256(':' || {}), 1, 12)"
D_NESTED = duck(f"SELECT ordinal, {_P.format('user_id')} AS user_id, contains(message, 'token=tok') AS hidden, {_P.format('trace_id')} AS token, {_P.format('pod')} AS email, 'from [IP_REDACTED] at ' || host AS path FROM logs")


def q_objects_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events as answers would say them: alone, in a sentence, with stray braces, or not at all."""
    said = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Here: ', props, ' as asked.') WHEN 2 THEN concat('See ', props, ' and not {this}') ELSE replace(props, '}', '') END")
    found = read(spark, sf_dir, "events").select("event_id", nested.found_object(said).alias("f"))
    return found.groupBy("f.method", F.try_variant_get("f.object", "$.k", "long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


REVISION_EVENTS = """concat(service, '/', {day}) AS incident, ts, ordinal, CASE WHEN event_name = 'purchase' THEN 'decision' ELSE 'evidence' END AS kind,
  CASE WHEN event_name <> 'purchase' THEN concat(event_name, '-', k % 12) END AS evidence_id, CAST(k % 3 AS INT) + 1 AS expected,
  CASE k % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'request_more_evidence' ELSE 'maybe' END AS decision, CASE WHEN user_id % 2 = 0 THEN '1' END AS selected, CAST(NULL AS STRING) AS request_id"""


def q_revision_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as evidence of their service and day, purchases as review decisions."""
    spark_sql = REVISION_EVENTS.replace("{day}", "date_format(ts, 'yyyy-MM-dd')")
    return revisions.replayed(spark.sql(f"SELECT {spark_sql} FROM {{rows}}", rows=logs(spark, sf_dir)))


D_REVISIONS = duck(f"""WITH RECURSIVE e0 AS (SELECT {REVISION_EVENTS.replace("{day}", "strftime(ts, '%Y-%m-%d')")} FROM logs),
  e AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY ts, ordinal) AS i, row_number() OVER (PARTITION BY incident, kind, evidence_id ORDER BY ts, ordinal) > 1 AS dup,
    expected || '|' || decision || '|' || coalesce(selected, '') || '|' AS key FROM e0),
  s AS (SELECT DISTINCT incident, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ordinal, '' AS kind, 0 AS revision, false AS frozen, '' AS last_decision, '' AS decided, '' AS outcome, CAST(NULL AS VARCHAR) AS reason FROM e
    UNION ALL SELECT incident, i, ordinal, kind, CASE WHEN outcome = 'opened' THEN revision + 1 ELSE revision END, CASE WHEN outcome = 'opened' THEN false WHEN outcome = 'decided' THEN true ELSE frozen END,
      CASE WHEN outcome = 'opened' THEN '' WHEN outcome = 'decided' THEN decision ELSE last_decision END, CASE WHEN outcome = 'opened' THEN '' WHEN outcome = 'decided' THEN key ELSE decided END, outcome,
      CASE WHEN outcome = 'opened' THEN CASE last_decision WHEN '' THEN 'first_evidence' WHEN 'request_more_evidence' THEN 'requested_evidence' ELSE 'late_evidence' END
        WHEN outcome = 'refused' THEN CASE WHEN revision = 0 THEN 'no_revision' WHEN expected <> revision THEN 'stale_revision' WHEN decision = 'maybe' THEN 'invalid_decision' WHEN decision = 'approved' AND selected IS NULL THEN 'no_selection' ELSE 'already_decided' END END
    FROM (SELECT s.incident, e.i, e.ordinal, e.kind, s.revision, s.frozen, s.last_decision, s.decided, e.expected, e.decision, e.selected, e.key,
      CASE WHEN e.kind = 'evidence' THEN CASE WHEN dup THEN 'duplicate' WHEN s.revision > 0 AND NOT s.frozen THEN 'added' ELSE 'opened' END
        WHEN s.revision = 0 OR e.expected <> s.revision OR e.decision = 'maybe' OR (e.decision = 'approved' AND e.selected IS NULL) THEN 'refused'
        WHEN s.frozen THEN CASE WHEN s.decided = e.key THEN 'repeated' ELSE 'refused' END ELSE 'decided' END AS outcome
      FROM s JOIN e ON e.incident = s.incident AND e.i = s.i + 1))
  SELECT incident, ordinal, kind, revision, outcome, reason FROM s WHERE i > 0""")


def q_grounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on the three largest error groups of a day: the first is linked with the day's largest warning, the third cites what nobody knows."""
    found = kept_groups(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("incident", "level").orderBy(F.desc("n"), "event_id"))
    ranked = found.withColumn("rank", place)
    warning = ranked.filter("level = 'warn' AND rank = 1").select("incident", F.col("event_id").alias("w"))
    top = written(ranked.filter("level = 'error' AND rank <= 3").select("incident", "rank", F.col("event_id").alias("e")).join(warning, "incident"), "claimed")
    candidates = top.select("incident", "rank", F.array("e").alias("event_ids"), F.array("w").alias("impact_event_ids"))
    links = top.filter("rank = 1").select("incident", F.lit(1).alias("link_id"), F.array("e", "w").alias("supporting_event_ids"))
    said = F.array(
        F.struct(F.lit("cause").alias("field"), F.when(F.col("rank") < 3, F.array("e")).otherwise(F.array("e", F.lit("log-none"))).alias("ids")),
        F.struct(F.lit("mechanism").alias("field"), F.array("e", "w").alias("ids")), F.struct(F.lit("impact").alias("field"), F.when(F.col("rank") < 3, F.array("w")).otherwise(F.array("e")).alias("ids")))
    claims = top.withColumn("c", F.explode(said)).select("incident", "rank", "c.field", F.lit("said").alias("text"), F.when(F.col("rank") == 1, "observed").otherwise("inferred").alias("status"), F.col("c.ids").alias("evidence_ids"))
    known = found.select("incident", "event_id")
    judged = grounding.grounded_claims(claims, grounding.evidence_roles(candidates, links, known), links, known)
    return judged.select("incident", "rank", "field", "status", "decision", "reason", F.array_join("valid_ids", ",").alias("valid"), F.array_join("unknown_ids", ",").alias("unknown"), F.array_join("incompatible_ids", ",").alias("incompatible"))


_R = grounding.REASONS
D_GROUNDED = with_groups(f"""SELECT incident, rank, field, CASE WHEN d = 'rejected' THEN 'unknown' WHEN rank = 1 AND field = 'cause' THEN 'hypothesis' ELSE 'inferred' END AS status, d AS decision,
    CASE WHEN d = 'supported' THEN '{_R["supported"]}' WHEN d = 'rejected' THEN CASE WHEN field = 'cause' THEN '{_R["unknown"]}' ELSE '{_R["incompatible"]}' END WHEN field = 'cause' THEN '{_R["cause"]}' WHEN field = 'mechanism' THEN '{_R["linked"]}' ELSE '{_R["impact"]}' END AS reason,
    CASE field WHEN 'cause' THEN e WHEN 'mechanism' THEN CASE WHEN rank = 1 THEN e || ',' || w ELSE '' END ELSE CASE WHEN rank < 3 THEN w ELSE '' END END AS valid,
    CASE WHEN field = 'cause' AND rank = 3 THEN 'log-none' ELSE '' END AS unknown, CASE WHEN field = 'mechanism' AND rank > 1 THEN e || ',' || w WHEN field = 'impact' AND rank = 3 THEN e ELSE '' END AS incompatible
  FROM (SELECT *, CASE WHEN (field = 'cause' AND rank = 3) OR (field = 'mechanism' AND rank > 1) OR (field = 'impact' AND rank = 3) THEN 'rejected' WHEN rank = 1 THEN 'downgraded' ELSE 'supported' END AS d
    FROM (SELECT incident, event_id AS e, row_number() OVER (PARTITION BY incident ORDER BY n DESC, event_id) AS rank FROM grouped WHERE level = 'error' QUALIFY rank <= 3)
    JOIN (SELECT incident, event_id AS w FROM grouped WHERE level = 'warn' QUALIFY row_number() OVER (PARTITION BY incident ORDER BY n DESC, event_id) = 1) USING (incident), (VALUES ('cause'), ('mechanism'), ('impact')) f(field))""")


QUERIES = {
    "grounded_claims": (q_grounded_claims, D_GROUNDED),
    "revision_outcomes": (q_revision_outcomes, D_REVISIONS),
    "evidence_packs": (q_evidence_packs, D_PACKS),
    "stage_retention": (q_stage_retention, D_RETENTION),
    "decision_parts": (q_decision_parts, D_PARTS),
    "nested_redaction": (q_nested_redaction, D_NESTED),
    "objects_in_text": (q_objects_in_text, """SELECT CASE event_id % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'braces' WHEN 2 THEN 'balanced' ELSE 'none' END AS method,
      CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, count(*) AS n FROM events GROUP BY ALL"""),
}
