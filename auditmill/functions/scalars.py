"""Scalar functions of audit records, as Spark expressions; configuration helpers in Python."""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64
MAX_STRING_BYTES, MAX_PAYLOAD_BYTES = 2048, 64_000
GLOBAL = "__global__"


def present(value: Column) -> Column:
    """A tenant is present: not null and not only white space."""
    return F.coalesce(F.trim(F.regexp_replace(value, r"\s+", " ")) != "", F.lit(False))


def cap_string(value: Column, most: int = MAX_STRING_BYTES) -> Column:
    """value if its UTF-8 takes at most `most` bytes (or most <= 0), else its first bytes and an ellipsis.

    The cut backs up over continuation bytes and keeps the lead byte before them, so a replacement character may precede the ellipsis."""
    if most <= 0:
        return value
    head = F.hex(F.substring(value.cast("binary"), 1, most))
    lead = F.regexp_replace(head, "(?:[89AB][0-9A-F])+$", "")
    kept = F.unhex(F.when(lead == "", head).otherwise(lead))
    return F.when(F.octet_length(value) <= most, value).otherwise(F.concat(F.make_valid_utf8(kept.cast("string")), F.lit("…")))


def json_string(value: Column) -> Column:
    """value as a JSON string; null as null. Control characters have lower-case escapes."""
    held = F.to_json(F.struct(value.alias("v")))
    quoted = F.substr(held, F.lit(6), F.length(held) - 6)
    lower = quoted
    for code in (*range(0x0A, 0x10), *range(0x1A, 0x20)):
        if f"{code:04X}" != f"{code:04x}":
            # an escaped backslash before a u is no escape of ours
            lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    plain = F.concat(F.lit('"'), value, F.lit('"'))
    # most texts hold nothing that JSON escapes
    return F.when(value.isNull(), "null").when(~value.rlike(r'[\x00-\x1f"\\]'), plain).when(~value.rlike(r"[\x00-\x1f]"), quoted).otherwise(lower)


def safe_json(value: Column) -> Column:
    """value, if it is JSON; else, and where it is empty, null."""
    return F.when((value != "") & F.try_parse_json(value).isNotNull(), value)


def integrity_payload() -> Column:
    """The canonical JSON of a record's nine sealed fields. Bags are their stored JSON text."""
    bag = lambda c: F.coalesce(F.col(c), F.lit("null"))
    fields = [("id", json_string(F.col("id"))), ("tenantId", json_string(F.col("tenant_id"))), ("actorId", json_string(F.col("actor_id"))), ("action", json_string(F.col("action"))), ("entityId", json_string(F.col("entity_id"))),
              ("oldValues", bag("old_values")), ("newValues", bag("new_values")), ("metadata", bag("metadata")), ("createdAt", json_string(F.col("created_at")))]
    parts = [x for k, (name, c) in enumerate(fields) for x in (F.lit(("," if k else "{") + f'"{name}":'), c)]
    return F.concat(*parts, F.lit("}"))


def content_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev, F.lit("\n"), payload).cast("binary"), 256)


def uuid7_ms(value: Column) -> Column:
    """Milliseconds of a UUIDv7; -1 if value is no UUID."""
    plain = F.lower(F.replace(value, F.lit("-"), F.lit("")))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.conv(F.substring(plain, 1, 12), 16, 10).cast("long")).otherwise(F.lit(-1).cast("long"))


def uuid_version(value: Column) -> Column:
    plain = F.lower(F.replace(value, F.lit("-"), F.lit("")))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.conv(F.substring(plain, 13, 1), 16, 10).cast("int")).otherwise(-1)


def uuid_is_rfc(value: Column) -> Column:
    plain = F.lower(F.replace(value, F.lit("-"), F.lit("")))
    return F.coalesce(plain.rlike("^[0-9a-f]{16}[89ab][0-9a-f]{15}$"), F.lit(False))


def client_ip(forwarded: Column, real: Column, proxies: int) -> Column:
    """The client's address when `proxies` proxies are trusted: from the right of the forwarded list, or its first; else the real-IP header."""
    if proxies < 1:
        return F.lit(None).cast("string")
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda x: F.trim(x)), lambda x: x != "")
    at = F.get(hops, F.greatest(F.size(hops) - 1 - proxies, F.lit(0)))
    own = F.trim(real)
    return F.coalesce(at, F.when(own != "", own))


def tenant_key(value: Column) -> Column:
    """A name for a tenant that is safe in paths."""
    joined = F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9_-]+", "_"), "_+", "_")
    trimmed = F.substring(F.regexp_replace(joined, "^_|_$", ""), 1, 128)
    # FNV-1a over UTF-16 units
    units = F.filter(F.split(F.hex(F.encode(value, "UTF-16BE")), "(?<=\\G....)"), lambda x: x != "")
    step = lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    digest = F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step))), 8, "0")
    return F.when(value.isNull() | (value == ""), GLOBAL).when(value.rlike("^[a-zA-Z0-9_-]{1,128}$"), value).when(trimmed != "", trimmed).otherwise(F.concat(F.lit("t_"), digest))


def clickhouse_datetime(iso: Column) -> Column:
    """'YYYY-MM-DD HH:mm:ss.SSS' in UTC; text that is no time loses its T, its zone and all after 23 characters."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(iso, "^([^T]*)T", "$1 "), "[zZ]$", ""), "[+-][0-9]{2}:[0-9]{2}$", "")
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "yyyy-MM-dd HH:mm:ss.SSS"), F.substring(plain, 1, 23))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def month(iso: Column) -> Column:
    """YYYYMM of an ISO text, the table's partition."""
    return F.concat(F.substring(iso, 1, 4), F.substring(iso, 6, 2)).cast("int")


def shrink(old: Column, new: Column, metadata: Column, most: int = MAX_PAYLOAD_BYTES) -> dict[str, Column]:
    """The three bags, and whether any was dropped: metadata goes first, then old_values, then new_values, until the rest fits."""
    names = ("oldValues", "newValues", "metadata")
    if most <= 0:
        return {"old_values": old, "new_values": new, "metadata": metadata, "truncated": F.lit(False)}

    def size(*bags: Column | None) -> Column:
        held = [F.when(b.isNull(), 0).otherwise(F.octet_length(b) + len(n) + 3) for b, n in zip(bags, names, strict=True) if b is not None]
        several = [F.when(b.isNull(), 0).otherwise(1) for b in bags if b is not None]
        total, count = sum(held, F.lit(2)), sum(several, F.lit(0))
        return total + F.greatest(count - 1, F.lit(0))

    whole, no_meta, no_old = size(old, new, metadata) <= most, size(old, new, None) <= most, size(None, new, None) <= most
    return {"metadata": F.when(whole, metadata), "old_values": F.when(whole | no_meta, old), "new_values": F.when(whole | no_meta | no_old, new), "truncated": ~whole}


def backoff_ms(attempt: Column, base: int = 1000) -> Column:
    return (F.lit(base) * F.pow(F.lit(2), attempt - 1)).cast("long")


def namespace(value: str) -> str:
    """value, if it may name a place on disk."""
    if not re.fullmatch(r"[a-zA-Z0-9_-]{1,64}", value or ""):
        raise ValueError("a namespace has 1 to 64 letters, digits, _ or -")
    return value


def normalise_key(key: bytes | str) -> bytes:
    """32 bytes as they are, as 64 hex digits or as base64; any other text by its SHA-256."""
    if not key:
        raise ValueError("an empty key")
    if isinstance(key, bytes):
        return key if len(key) == 32 else hashlib.sha256(key).digest()
    if re.fullmatch(r"[0-9a-fA-F]{64}", key):
        return bytes.fromhex(key)
    try:
        raw = base64.b64decode(key, validate=True)
    except ValueError:
        raw = b""
    return raw if len(raw) == 32 else hashlib.sha256(key.encode()).digest()


def encrypt(text: Column, key: Column, iv: Column) -> Column:
    """'e1:' iv ':' ciphertext and tag, AES-256-GCM; iv is 12 bytes that are never used twice with a key."""
    sealed = F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), iv)
    # Spark may break base64 into lines
    return F.concat(F.lit("e1:"), F.base64(iv), F.lit(":"), F.translate(F.base64(F.substring(sealed, 13, 2**31 - 1)), "\r\n", ""))


def decrypt(text: Column, key: Column) -> Column:
    """The plain text; text without the prefix as it is; null if the tag is wrong."""
    parts = F.split(text, ":")
    sealed = F.concat(F.unbase64(F.get(parts, F.lit(1))), F.unbase64(F.get(parts, F.lit(2))))
    return F.when(text.startswith("e1:"), F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")).otherwise(text)
