"""Canonical relations built from the star-schema tables. The SQL is shared by Spark and by the checking engine:
the two differences between the dialects are the parameters `{k}` and `{ts}`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import pin_semantics

#: One log record for each event: service, level, error type, dimensions and a message with codes, ids and measures.
LOGS = """
SELECT event_id AS ordinal, ts, service, level, error_type, event_type AS event_name, status_code, pod, host, trace_id, user_id, k, value,
  CASE WHEN event_type = 'view' THEN concat('/item/', CAST(k % 9 AS STRING)) END AS route, CASE WHEN event_type = 'error' AND k % 6 = 1 THEN 'upstream-api' END AS dependency,
  CASE WHEN k % 8 = 0 THEN '' ELSE concat('region-', CAST(user_id % 2 AS STRING)) END AS region, concat('w', CAST(k % 7 AS STRING)) AS workload_id, CASE WHEN event_type <> 'click' THEN concat('x', CAST(k % 4 AS STRING)) END AS execution_id,
  CASE WHEN event_type = 'error' THEN
    CASE k % 6
      WHEN 0 THEN concat('connection pool exhausted SQLSTATE[53300] user_id=', user_id, ' waited ', whole, ' ms')
      WHEN 1 THEN concat('upstream timed out HTTP 504 trace_id=', trace_id, ' after ', whole, ' seconds')
      WHEN 2 THEN concat('no such host db', k, ' error_code=EAI_AGAIN host=', host)
      WHEN 3 THEN concat('OOMKilled exit code: 137 pod=', pod, ' used ', whole, ' MB')
      WHEN 4 THEN concat('disk full: no space left on device sd', k % 3, ' at 0x', trace_id)
      ELSE concat('connection refused by peer=10.0.0.', k, ' retry ', whole)
    END
  WHEN event_type = 'view' THEN concat('GET /item/', k, ' status=200 user_id=', user_id, ' in ', whole, ' ms')
  WHEN event_type = 'purchase' THEN concat('payment accepted token=tok', user_id, ' request_id=req-', trace_id)
  WHEN event_type = 'signup' THEN concat('deployed commit ', trace_id, ' by user', k, '@example.com')
  ELSE concat('click from 10.1.2.', k, ' broken pipe on button ', k)
  END AS message
FROM (
  SELECT *, concat('pod-', CAST(k % 3 AS STRING)) AS pod, concat('node', CAST(k % 4 AS STRING)) AS host,
    substr(md5(CAST(event_id AS STRING)), 1, 12) AS trace_id, CAST(floor(value) AS BIGINT) AS whole,
    CASE user_id % 5 WHEN 0 THEN 'payments' WHEN 1 THEN 'checkout' WHEN 2 THEN 'auth' WHEN 3 THEN 'search' ELSE 'catalog' END AS service,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' ELSE 'info' END AS level,
    CASE WHEN event_type = 'error' THEN
      CASE k % 6 WHEN 0 THEN 'db_pool' WHEN 1 THEN 'upstream_timeout' WHEN 2 THEN 'dns' WHEN 3 THEN 'oom' WHEN 4 THEN 'disk' ELSE 'refused' END
    END AS error_type,
    CASE event_type WHEN 'view' THEN '200' WHEN 'error' THEN CASE WHEN k % 6 = 1 THEN '504' ELSE '500' END END AS status_code
  FROM (SELECT event_id, {ts} AS ts, user_id, event_type, value, {k} AS k FROM {events})
)
"""
#: One deployment for each signup.
DEPLOYS = """
SELECT ordinal AS deploy_id, ts AS deployed_at, service, substr(trace_id, 1, 7) AS commit FROM {logs} WHERE event_name = 'signup'
"""
#: One operation for each distinct order line: from order to shipment, the earliest where a line is repeated.
OPERATIONS = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS operation_id,
  min(concat(o_orderpriority, '|', o_orderstatus, '|', l_returnflag, '|', CAST(o_custkey % 20 AS STRING))) AS cohort, min({seconds}) AS duration
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1
"""

SPARK = {"k": "CAST(get_json_object(props, '$.k') AS BIGINT)", "ts": "CAST(ts AS TIMESTAMP)", "seconds": "CAST(unix_seconds(CAST(l_shipdate AS TIMESTAMP)) - unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS DOUBLE)"}
DUCK = {"k": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "ts": "ts", "seconds": "CAST(epoch(l_shipdate) - epoch(o_orderdate) AS DOUBLE)"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; zone-less timestamps become UTC timestamps here and nowhere else."""
    df = pin_semantics(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema:
        if field.dataType.typeName() == "timestamp_ntz" and name != "events":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _filled(template: str, given: dict[str, str], **tables: DataFrame) -> str:
    for key, value in given.items():
        template = template.replace("{" + key + "}", value)
    return template


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_filled(LOGS, SPARK), events=read(spark, sf_dir, "events"))


def deploys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DEPLOYS, logs=logs(spark, sf_dir))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with a duration; those that end before they start are no operations."""
    found = spark.sql(_filled(OPERATIONS, SPARK), lineitem=read(spark, sf_dir, "lineitem"), orders=read(spark, sf_dir, "orders"))
    return found.filter("duration >= 0")


def duck(query: str) -> str:
    """`query` with the relations it names in front."""
    logs_sql = _filled(LOGS, {**DUCK, "events": "events"})
    parts = [f"logs AS ({logs_sql})", f"deploys AS ({DEPLOYS.replace('{logs}', 'logs')})"]
    if "operations" in query:
        ops = _filled(OPERATIONS, {**DUCK, "lineitem": "lineitem", "orders": "orders"})
        parts.append(f"operations AS (SELECT * FROM ({ops}) WHERE duration >= 0)")
    query = query.strip()
    if query.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {query[15:]}"
    if query.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {query[5:]}"
    return f"WITH {', '.join(parts)} {query}"
