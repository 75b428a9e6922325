"""Tables of the engine, and audit logs derived from an events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions.scalars import iso_millis

LOG = "id string, tenant_id string, actor_id string, action string, entity_id string, old_values string, new_values string, metadata string, ip_address string, user_agent string, created_at string, prev_hash string, content_hash string"
COLUMNS = [x.split()[0] for x in LOG.split(", ")]
DLQ = f"id string, state string, tenant_id string, attempts int, logs array<struct<{LOG.replace(' string', ':string')}>>, created_ms long"


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit logs made from events: a UUIDv7 of time and number, tenants by user, bags from props. event_id is kept last."""
    ts = F.col("ts").cast("timestamp")
    ms = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    n = F.col("event_id")
    id_ = F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.lpad(F.lower(F.hex(n % 4096)), 3, "0"), F.lit("-8"), F.lpad(F.lower(F.hex(F.floor(n / 4096))), 3, "0"), F.lit("-"), F.lpad(F.lower(F.hex(n)), 12, "0"))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    none = F.lit(None).cast("string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        id_.alias("id"), text("t", F.col("user_id") % 10).alias("tenant_id"), text("u", F.col("user_id")).alias("actor_id"), F.concat(F.lit("event."), "event_type").alias("action"),
        F.when(n % 7 != 0, text("e", n % 97)).alias("entity_id"), none.alias("old_values"), F.col("props").alias("new_values"), none.alias("metadata"), none.alias("ip_address"), none.alias("user_agent"),
        iso_millis(ts).alias("created_at"), none.alias("prev_hash"), none.alias("content_hash"), n.alias("event_id"))


#: The same in DuckDB's SQL, as the start of a query.
EVENT_LOGS_SQL = """audit_logs AS (SELECT substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-7' || printf('%03x', event_id % 4096) || '-8' || printf('%03x', event_id // 4096) || '-' || printf('%012x', event_id) AS id,
  't' || (user_id % 10)::VARCHAR AS tenant_id, 'u' || user_id::VARCHAR AS actor_id, 'event.' || event_type AS action, CASE WHEN event_id % 7 <> 0 THEN 'e' || (event_id % 97)::VARCHAR END AS entity_id,
  NULL::VARCHAR AS old_values, props AS new_values, NULL::VARCHAR AS metadata, NULL::VARCHAR AS ip_address, NULL::VARCHAR AS user_agent, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at,
  NULL::VARCHAR AS prev_hash, NULL::VARCHAR AS content_hash, event_id FROM (SELECT *, printf('%012x', epoch_us(ts) // 1000) AS m FROM events))"""
