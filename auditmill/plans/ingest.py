"""What happens to a record between a producer and the journal: context, caps, redaction, shrinking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.functions import scalars
from auditmill.functions.udfs import redact


@dataclass(frozen=True)
class Limits:
    string_bytes: int = scalars.MAX_STRING_BYTES
    payload_bytes: int = scalars.MAX_PAYLOAD_BYTES
    redact: tuple[str, ...] = ()
    require_tenant: bool = False


def with_request_context(logs: DataFrame, proxies: int = 0, tenant_header: str | None = "x_tenant_id") -> DataFrame:
    """ip_address, user_agent and tenant_id from header columns (x_forwarded_for, x_real_ip, user_agent_header, tenant_header). A stated tenant wins."""
    out = logs.withColumns({"ip_address": scalars.client_ip(F.col("x_forwarded_for"), F.col("x_real_ip"), proxies), "user_agent": F.col("user_agent_header")})
    return out.withColumn("tenant_id", F.coalesce("tenant_id", tenant_header)) if tenant_header else out


def split_by_tenant(logs: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Rows that may go on, and those that lack a tenant they need."""
    has = scalars.present(F.col("tenant_id"))
    return (logs.where(has), logs.where(~has)) if limits.require_tenant else (logs, logs.where(F.lit(False)))


def sanitised(logs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """logs capped, redacted and shrunk, with capped and truncated flags. A tenant is never capped: two could become one."""
    text = ("actor_id", "action", "entity_id", "user_agent", "ip_address")
    over = [F.coalesce(F.octet_length(c) > limits.string_bytes, F.lit(False)) for c in text]
    capped = over[0]
    for x in over[1:]:
        capped = capped | x
    out = logs.withColumn("capped", capped if limits.string_bytes > 0 else F.lit(False)).withColumns({c: scalars.cap_string(F.col(c), limits.string_bytes) for c in text})
    out = redact(out, limits.redact)
    return out.withColumns(scalars.shrink(F.col("old_values"), F.col("new_values"), F.col("metadata"), limits.payload_bytes))
