"""Object keys, changelog keys and values, and other scalar rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_topic(topic: Column) -> Column:
    """Percent-quotes all but letters, digits and ``_.-~``; nothing else is safe in an object key."""
    out = F.url_encode(topic)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_object_key(uri: Column, bucket: str, prefix: str = "") -> Column:
    """A key without scheme, bucket and prefix; keys that are bare already stay."""
    bare = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.when(uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") & bare.startswith(f"{bucket}/"), F.substr(bare, F.lit(len(bucket) + 2))).otherwise(bare)
    bare = F.regexp_replace(bare, "^/+", "")
    if prefix:
        prefix = prefix.strip("/") + "/"
        bare = F.when(bare.startswith(prefix), F.substr(bare, F.lit(len(prefix) + 1))).otherwise(bare)
    return bare


def segment_key(topic: Column, partition: Column, low: Column, high: Column, generation: Column) -> Column:
    return F.concat(F.lit("topics/"), escape_topic(topic), F.format_string("/%010d/%020d-%020d-gen%d.parquet", partition, low, high, generation))


def _bytes(number: Column, width: int) -> Column:
    """Big-endian two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * width)))


def _string(text: Column) -> Column:
    """A 16-bit length and UTF-8 bytes; null has the length -1."""
    data = F.encode(text, "UTF-8")
    return F.when(text.isNull(), F.unhex(F.lit("FFFF"))).otherwise(F.concat(_bytes(F.length(data), 2), data))


def offset_key(group: Column, topic: Column, partition: Column) -> Column:
    return F.concat(_bytes(F.lit(1), 2), _string(group), _string(topic), _bytes(partition, 4))


def offset_value(offset: Column, metadata: Column, commit_ms: Column) -> Column:
    return F.concat(_bytes(F.lit(1), 2), _bytes(offset, 8), _string(metadata), _bytes(commit_ms, 8), _bytes(F.lit(-1), 8))


def read_number(data: Column, start: int | Column, width: int) -> Column:
    """A signed big-endian number at a 1-based position."""
    raw = F.conv(F.hex(F.substr(data, F.lit(start) if isinstance(start, int) else start, F.lit(width))), 16, -10).cast("long")
    return raw if width == 8 else F.when(raw >= 1 << (8 * width - 1), raw - (1 << 8 * width)).otherwise(raw)


def decode_offset_value(data: Column) -> Column:
    """``offset, metadata, commit_ms`` of a changelog value; null for a tombstone."""
    n = read_number(data, 11, 2)
    text = F.when(n >= 0, F.decode(F.substr(data, F.lit(13), n.cast("int")), "UTF-8"))
    at = (F.lit(13) + F.greatest(n, F.lit(0))).cast("int")
    return F.when(data.isNotNull(), F.struct(read_number(data, 3, 8).alias("offset"), text.alias("metadata"), read_number(data, at, 8).alias("commit_ms")))


def commit_timestamp_ms(at: Column) -> Column:
    return F.coalesce(F.unix_millis(at), F.lit(-1))


def transactional_id(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


def next_epoch(epoch: Column) -> Column:
    return (epoch + 1) % 32768


def record_bytes(key: Column, value: Column, headers: Column) -> Column:
    """Estimate of a record's size: its parts and 64 bytes."""
    head = F.aggregate(F.coalesce(headers, F.array().cast("array<struct<key:string,value:binary>>")), F.lit(0), lambda n, h: n + F.length(h["key"]) + F.coalesce(F.length(h["value"]), F.lit(0)))
    return (F.coalesce(F.length(key), F.lit(0)) + F.coalesce(F.length(value), F.lit(0)) + head + 64).cast("long")


def row_group_rows(target_bytes: int, mean_row_bytes: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(target_bytes) / F.greatest(F.lit(64), mean_row_bytes)))


def protocol_digest(protocols: Column) -> Column:
    """SHA-256 over rank, name, 0x00, metadata, 0xFF of ``array<struct<rank,name,metadata>>`` in rank order."""
    packed = F.transform(F.array_sort(protocols), lambda p: F.concat(F.hex(p["rank"].cast("string").cast("binary")), F.hex(F.encode(p["name"], "UTF-8")), F.lit("00"), F.coalesce(F.hex(p["metadata"]), F.lit("")), F.lit("FF")))
    return F.sha2(F.unhex(F.array_join(packed, "")), 256)


def static_member_id(group: Column, instance: Column) -> Column:
    return F.concat_ws(":", group, instance)


def dynamic_member_id(group: Column, request: Column, now_ms: int) -> Column:
    """An id for a member that came without one; made of its request, so that a task run again makes the same one."""
    return F.concat(F.lit("member-"), F.md5(F.concat_ws(":", group, request.cast("string"), F.lit(str(now_ms)))))


def capped_deadline(now: Column, window_ms: Column, cap_ms: int = 120_000, current: Column | None = None) -> Column:
    """``now`` plus the window, at most the cap; an existing deadline is only ever shortened."""
    at = now + F.least(window_ms, F.lit(cap_ms))
    return at if current is None else F.least(at, F.coalesce(current, at))
