"""Queries over series, operations, traces and truth: baselines, distributions, clustering metrics, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import sanitize, text
from emberline.operators import grouping, sampling, statistics
from emberline.plans.log_queries import FINGERPRINT, shown, with_signed
from emberline.sources import relations
from emberline.sources.relations import duck, logs, read


def q_metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = logs(spark, sf_dir).select("service", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "value")
    found = statistics.series_summary(points, ["service", "day"])
    return found.select("service", "day", "first_value", "last_value", "peak_value", shown("peak_time"), "samples", "trend", "change_ratio")


def q_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rates(logs(spark, sf_dir), "5 minutes", "5 minutes").select("service", shown("start"), "requests", "error_rate", "rate")


def q_error_rate_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rates(logs(spark, sf_dir)).groupBy("service").agg(F.count(F.lit(1)).alias("windows"), F.sum("requests").alias("requests"), F.max("requests").alias("most"))


def q_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 95th percentile of values (as latencies) by service and day, in thousandths."""
    rows = logs(spark, sf_dir).select("service", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return statistics.interpolated(rows, ["service", "day"], "value", 0.95).select("service", "day", F.round(F.col("quantile") * 1000, 3).alias("p95_ms"))


def q_peer_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.peer_baselines(relations.operations(spark, sf_dir))
    return found.select("operation_id", "peer_count", *[F.round(c, 4).alias(c) for c in ("center", "mad", "ratio", "percentile_rank")], F.round("robust_z", 9).alias("robust_z"), "status")


D_PEER = duck("""WITH p AS (SELECT a.operation_id, a.duration, count(b.operation_id) AS peer_count, median(b.duration) AS center, count(*) FILTER (b.duration <= a.duration) AS below
    FROM operations a LEFT JOIN operations b ON a.cohort = b.cohort AND a.operation_id <> b.operation_id GROUP BY ALL),
  m AS (SELECT p.operation_id, median(abs(b.duration - p.center)) AS mad FROM p JOIN operations a USING (operation_id) JOIN operations b ON a.cohort = b.cohort AND a.operation_id <> b.operation_id GROUP BY ALL),
  f AS (SELECT p.*, mad, CASE WHEN center > 0 THEN p.duration / center END AS ratio, CASE WHEN peer_count > 0 THEN 100.0 * below / peer_count END AS percentile_rank, CASE WHEN mad > 0 THEN 0.6745 * (p.duration - center) / mad END AS robust_z FROM p LEFT JOIN m USING (operation_id))
  SELECT operation_id, peer_count, round(center, 4) AS center, round(mad, 4) AS mad, round(ratio, 4) AS ratio, round(percentile_rank, 4) AS percentile_rank, round(robust_z, 9) AS robust_z,
    CASE WHEN peer_count >= 20 AND mad > 0 AND percentile_rank >= 95 AND ratio >= 1.25 AND robust_z >= 3.5 THEN 'deviation_observed' WHEN peer_count >= 20 AND mad > 0 THEN 'within_peer_baseline' ELSE 'insufficient_baseline' END AS status FROM f""")


def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.distribution(relations.operations(spark, sf_dir).withColumn("priority", F.split("cohort", r"\|")[0]), ["priority"], "duration")
    return found.select("priority", "n", "least", "median", "p90", "most", "mad", "upper_median")


def q_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint groups against event type and code as truth."""
    signed = grouping.with_signature(logs(spark, sf_dir))
    assigned = signed.select("ordinal", F.lit("all").alias("case"), F.concat_ws("|", "service", "level", "signature").alias("predicted"))
    truth = logs(spark, sf_dir).select("ordinal", F.concat_ws("/", "service", "event_name", F.coalesce("error_type", F.lit("-"))).alias("label"))
    return statistics.pairwise_grouping(assigned, truth)


D_PAIRWISE = with_signed("""SELECT 'all' AS "case", rows, groups, labels, tp, pp - tp AS fp, tt - tp AS fn, precision, recall, round(2 * precision * recall / (precision + recall), 4) AS f1, purity, collisions, fragmented FROM (
    SELECT *, round(tp / pp, 4) AS precision, round(tp / tt, 4) AS recall, round(dominant / rows, 4) AS purity FROM
    (SELECT CAST(sum(c * (c - 1) / 2) AS BIGINT) AS tp FROM cells), (SELECT CAST(sum(c * (c - 1) / 2) AS BIGINT) AS pp, CAST(sum(c) AS BIGINT) AS rows, CAST(sum(most) AS BIGINT) AS dominant, count(*) FILTER (labels > 1) AS collisions, count(*) AS groups
      FROM (SELECT predicted, sum(c) AS c, max(c) AS most, count(*) AS labels FROM cells GROUP BY predicted)),
    (SELECT CAST(sum(c * (c - 1) / 2) AS BIGINT) AS tt, count(*) FILTER (g > 1) AS fragmented, count(*) AS labels FROM (SELECT label, sum(c) AS c, count(*) AS g FROM cells GROUP BY label)))""").replace(
    " SELECT 'all' AS \"case\"", ", cells AS (SELECT service || '|' || level || '|' || signature AS predicted, service || '/' || event_name || '/' || coalesce(error_type, '-') AS label, count(*) AS c FROM signed GROUP BY ALL) SELECT 'all' AS \"case\"")


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select("service", (F.col("value") > 20).alias("predicted"), (F.col("level") == "error").alias("truth"))
    return statistics.confusion(rows, ["service"])


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each user and day."""
    return logs(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace"), F.col("ordinal").alias("position"), F.col("event_name").alias("event"))


_TRACES = "traces AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS trace, ordinal AS position, event_name AS event FROM logs)"


def q_event_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traces(spark, sf_dir)
    truth = found.groupBy("trace").agg((F.count_if(F.col("event") == "error") > 0).alias("failed"))
    return statistics.event_association(found, truth)


def q_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sequences(traces(spark, sf_dir), "error").select("trace", "events", "distinct_events", "first_event", "last_event", "after_marker", "ends_in_marker")


def q_shared_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.shared_sequences(traces(spark, sf_dir))


def q_conversation_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace"), F.col("turn").alias("position"), F.col("role").alias("event"))
    return statistics.shared_sequences(rows)


def q_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boolean features of labelled documents against their label."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 1000).alias("is_long"), F.contains("text", F.lit("\n")).alias("has_lines"))
    rows = docs.join(read(spark, sf_dir, "labels"), "doc_id").select("quality", F.explode(F.array(
        F.struct(F.lit("is_long").alias("feature"), F.col("is_long").alias("on")), F.struct(F.lit("has_lines").alias("feature"), F.col("has_lines").alias("on")))).alias("f"))
    return rows.groupBy("quality", "f.feature", "f.on").agg(F.count(F.lit(1)).alias("n"))


def q_lowest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.lowest_hash(logs(spark, sf_dir), "event_name", "ordinal", 40).select("event_name", "ordinal", F.col("rank").cast("long").alias("rank"))


def q_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.time_slices(logs(spark, sf_dir), ["service"], 4, 50).select("service", "ordinal", "slice")


D_STRATIFIED = duck("""WITH s AS (SELECT *, least(floor((epoch_us(ts) - lo) * 4 / greatest(hi - lo, 1)), 3) AS slice FROM (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY service) AS lo, max(epoch_us(ts)) OVER (PARTITION BY service) AS hi FROM logs)),
  r AS (SELECT service, ordinal, CAST(slice AS INTEGER) AS slice, 12 + CASE WHEN slice < 2 THEN 1 ELSE 0 END AS quota, row_number() OVER (PARTITION BY service, slice ORDER BY ts, ordinal) AS a,
    row_number() OVER (PARTITION BY service, slice ORDER BY ts DESC, ordinal DESC) AS z FROM s)
  SELECT service, ordinal, slice FROM r WHERE a <= ceil(quota / 2) OR z <= quota - ceil(quota / 2)""")


def q_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.even(logs(spark, sf_dir), ["service"], ["ts", "ordinal"], 17).select("service", "ordinal", F.col("place").cast("long").alias("place"))


def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(logs(spark, sf_dir), "event_name", ["ordinal"], 23).select("event_name", "ordinal", F.col("round").cast("long").alias("round"))


def q_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouping.with_signature(logs(spark, sf_dir)).withColumn("important", F.col("level").isin("error", "warn"))
    rows = rows.select("incident", "ordinal", "ts", "level", "message", "signature", "important")
    found = sampling.representative_sample(rows, "signature", 60, "important")
    return found.groupBy("incident").agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("signature").alias("shapes"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def q_label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day's labels (service, event and error type), those that a sample by smallest hashes has."""
    rows = logs(spark, sf_dir).withColumn("case", F.date_format("ts", "yyyy-MM-dd"))
    sample = sampling.lowest_hash(rows, "case", "ordinal", 60).select("ordinal", F.lit(True).alias("sampled"))
    label = F.concat_ws("/", "service", "event_name", F.coalesce("error_type", F.lit("-")))
    loud = sanitize.is_high_signal(F.col("level"), F.col("message"))
    return statistics.label_coverage(rows.join(sample, "ordinal", "left").select("case", label.alias("label"), F.coalesce("sampled", F.lit(False)).alias("sampled"), loud.alias("high_signal")))


D_COVERAGE = duck("""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS "case", service || '/' || event_name || '/' || coalesce(error_type, '-') AS label, ordinal,
    level IN ('error', 'warn') OR regexp_matches(message, '(?i)(error|exception|timeout|failed|lost|refused|exhausted|oomkilled|no space left|disk full|exit code|killed)') AS loud FROM logs),
  s AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY sha256("case" || '|' || ordinal), ordinal) <= 60 AS sampled FROM r),
  p AS (SELECT "case", label, count(*) AS n, bool_or(sampled) AS seen, bool_or(loud) AS loud, bool_or(sampled AND loud) AS loud_seen FROM s GROUP BY ALL),
  c AS (SELECT "case", count(*) AS labels, count(*) FILTER (seen) AS sampled_labels, count(*) FILTER (loud) AS high_signal_labels, count(*) FILTER (loud_seen) AS sampled_high_signal, count(*) FILTER (n <= 10) AS rare_labels,
    count(*) FILTER (n <= 10 AND seen) AS sampled_rare, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY ALL)
  SELECT *, CASE WHEN labels = 0 THEN 1.0 ELSE round(sampled_labels / labels, 4) END AS coverage, CASE WHEN high_signal_labels = 0 THEN 1.0 ELSE round(sampled_high_signal / high_signal_labels, 4) END AS high_signal_coverage,
    CASE WHEN rare_labels = 0 THEN 1.0 ELSE round(sampled_rare / rare_labels, 4) END AS rare_coverage FROM c""")


def q_sampling_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the sampler's shape: how many, and the first."""
    shape = text.sampling_shape(F.col("message"), [F.col(c) for c in ("service", "error_type", "event_name", "status_code")], F.col("level"))
    return logs(spark, sf_dir).groupBy(F.replace(shape, F.lit("\x1f"), F.lit("|")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))


_SAMPLED = FINGERPRINT.replace("(^|[^a-z0-9])[-+]?\\d+(?:\\.\\d+)?\\s*(?:bytes?|[kmgt]?i?b|milliseconds?|ms|seconds?|secs?)\\b', '\\1<measure>'", "~never~', ''").replace("'[-+]?\\d+(?:\\.\\d+)?'", "'\\d+(?:\\.\\d+)?'")
D_SAMPLING_SHAPES = duck(f"SELECT concat(service, '|', level, '|', coalesce(error_type, ''), '|', event_name, '|', coalesce(status_code, ''), '|', {_SAMPLED}) AS shape, count(*) AS n, min(ordinal) AS first FROM logs GROUP BY 1")


QUERIES = {
    "label_coverage": (q_label_coverage, D_COVERAGE),
    "sampling_shapes": (q_sampling_shapes, D_SAMPLING_SHAPES),
    "metric_series_summary": (q_metric_series, duck("""WITH p AS (SELECT DISTINCT service, strftime(ts, '%Y-%m-%d') AS day, ts, value FROM logs),
      s AS (SELECT service, day, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value, max(value) AS peak_value, count(*) AS samples FROM p GROUP BY ALL)
      SELECT s.*, strftime((SELECT min(ts) FROM p WHERE p.service = s.service AND p.day = s.day AND p.value = s.peak_value), '%Y-%m-%d %H:%M:%S') AS peak_time,
        CASE WHEN last_value > first_value THEN 'rising' WHEN last_value < first_value THEN 'falling' ELSE 'flat' END AS trend, CASE WHEN first_value <> 0 THEN round(peak_value / first_value, 2) END AS change_ratio FROM s""")),
    "error_rate_tumbling": (q_error_rate, duck("""SELECT service, strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS requests, round(count(*) FILTER (status_code LIKE '5%') / count(*), 6) AS error_rate,
      round(count(*) / 300, 6) AS rate FROM logs GROUP BY 1, 2""")),
    "error_rate_sliding": (q_error_rate_sliding, duck("""SELECT service, count(*) AS windows, CAST(sum(c) AS BIGINT) AS requests, max(c) AS most FROM (SELECT service, time_bucket(INTERVAL '1 minute', ts) - i * INTERVAL '1 minute' AS w, count(*) AS c
      FROM logs, (VALUES (0), (1), (2), (3), (4)) v(i) GROUP BY ALL) GROUP BY service""")),
    "p95_by_service": (q_p95, duck("SELECT service, strftime(ts, '%Y-%m-%d') AS day, round(quantile_cont(value, 0.95) * 1000, 3) AS p95_ms FROM logs GROUP BY ALL")),
    "peer_duration_features": (q_peer_duration, D_PEER),
    "distribution_summary": (q_distribution, duck("""WITH a AS (SELECT split_part(cohort, '|', 1) AS priority, list_sort(list(duration)) AS a, count(*) AS n, median(duration) AS median FROM operations GROUP BY 1)
      SELECT priority, n, a[1] AS least, median, a[CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1] AS p90, a[n] AS most, list_median(list_transform(a, lambda x: abs(x - median))) AS mad, a[n // 2 + 1] AS upper_median FROM a""".replace("list_median(", "list_aggregate(").replace("abs(x - median)))", "abs(x - median)), 'median')"))),
    "pairwise_grouping": (q_pairwise, D_PAIRWISE),
    "pair_confusion": (q_confusion, duck("""SELECT service, tp, fp, fn, tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(tn / (tn + fp), 4) AS specificity, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM (
      SELECT service, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM (SELECT service, value > 20 AS p, level = 'error' AS t FROM logs) GROUP BY service)""")),
    "event_association": (q_event_association, duck(f"""WITH {_TRACES}, truth AS (SELECT trace, bool_or(event = 'error') AS failed FROM traces GROUP BY trace)
      SELECT event, count(*) AS support, count(*) FILTER (failed) AS failed_support, round(count(*) FILTER (failed) / count(*), 4) AS precision, round(count(*) FILTER (failed) / (SELECT count(*) FROM truth WHERE failed), 4) AS recall
      FROM (SELECT DISTINCT trace, event FROM traces) JOIN truth USING (trace) GROUP BY event""")),
    "sequence_features": (q_sequences, duck(f"""WITH {_TRACES}, s AS (SELECT *, lead(event) OVER (PARTITION BY trace ORDER BY position) AS nxt FROM traces)
      SELECT *, coalesce(after_marker = 'end', false) AS ends_in_marker FROM (SELECT trace, count(*) AS events, count(DISTINCT event) AS distinct_events, arg_min(event, position) AS first_event, arg_max(event, position) AS last_event,
        arg_max(coalesce(nxt, 'end'), position) FILTER (event = 'error') AS after_marker FROM s GROUP BY trace)""")),
    "shared_sequence_count": (q_shared_sequences, duck(f"WITH {_TRACES} SELECT sequence, count(*) AS traces, CAST(max(n) AS INTEGER) AS length FROM (SELECT trace, sha256(string_agg(event, '>' ORDER BY position)) AS sequence, count(*) AS n FROM traces GROUP BY trace) GROUP BY sequence")),
    "conversation_sequences": (q_conversation_sequences, "SELECT sequence, count(*) AS traces, CAST(max(n) AS INTEGER) AS length FROM (SELECT conv_id, sha256(string_agg(role, '>' ORDER BY turn, role)) AS sequence, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY sequence"),
    "feature_crosstab": (q_crosstab, """SELECT quality, feature, "on", count(*) AS n FROM (SELECT doc_id, 'is_long' AS feature, length(text) > 1000 AS "on" FROM documents UNION ALL SELECT doc_id, 'has_lines', contains(text, chr(10)) FROM documents) JOIN labels USING (doc_id) GROUP BY ALL"""),
    "lowest_hash_sample": (q_lowest_hash, duck("SELECT event_name, ordinal, row_number() OVER (PARTITION BY event_name ORDER BY sha256(event_name || '|' || ordinal), ordinal) AS rank FROM logs QUALIFY rank <= 40")),
    "stratified_scan": (q_stratified, D_STRATIFIED),
    "even_sample": (q_even, duck("""WITH r AS (SELECT service, ordinal, row_number() OVER (PARTITION BY service ORDER BY ts, ordinal) - 1 AS place, count(*) OVER (PARTITION BY service) AS n FROM logs),
      s AS (SELECT DISTINCT service, CAST(round_even(i * (n - 1) / 16, 0) AS BIGINT) AS place FROM r, range(17) t(i)) SELECT service, ordinal, place FROM r JOIN s USING (service, place)""")),
    "round_robin_sample": (q_round_robin, duck("SELECT event_name, ordinal, row_number() OVER (PARTITION BY event_name ORDER BY ordinal) AS round FROM logs ORDER BY round, event_name LIMIT 23")),
    "representative_sample": (q_representative, None),
}
