"""Scalar functions over events, blocks, keys and segment ids; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a checksum starts from, as bytes before the body.
CHECKSUM_SEED = bytes.fromhex("1B39B11B")
#: Bytes of a block before its entries: two sizes, the stream's key, the start, the count, the checksum and the codec.
BLOCK_HEADER_BYTES = 4 + 8 + 4 + 4 + 4 + 4 + 1


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def checksum(body) -> Column:
    """CRC-32 of a body, seeded; unsigned, as BIGINT."""
    return F.crc32(F.concat(F.lit(CHECKSUM_SEED), _column(body)))


def event_body(stream="stream", version="version", sequence="sequence", type="type", data="data") -> Column:
    """The checksummed part of an event, in a text form that does not depend on the writer."""
    parts = [_column(c).cast("string") for c in (stream, version, sequence, type, data)]
    return F.encode(F.concat_ws("\x1f", *parts), "UTF-8")


def is_valid(checksum_col="checksum", body=None) -> Column:
    return _column(checksum_col) == checksum(event_body() if body is None else body)


def key_text(stream="stream", version="version") -> Column:
    """``stream@version``."""
    return F.concat(_column(stream), F.lit("@"), _column(version).cast("string"))


def _rendered(fields) -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{name}="), F.coalesce(_column(value).cast("string"), F.lit("null"))) for name, value in fields))


def render_event(stream_hash=None) -> Column:
    """An event as text: all fields of its record, its time in milliseconds; a null field reads ``null``."""
    key = F.xxhash64("stream") if stream_hash is None else _column(stream_hash)
    return _rendered((
        ("RECORD_SIZE", "rec_size"), ("CHECKSUM", checksum(event_body())), ("STREAM", "stream"), ("STREAM_HASH", key), ("VERSION", "version"), ("SEQUENCE", "sequence"),
        ("TIMESTAMP", F.unix_millis(F.col("ts").cast("timestamp"))), ("TYPE", "type"), ("DATA", "data"),
    ))


def render_record(stream="stream") -> Column:
    """All fields of an event as text, its time in milliseconds; ``stream`` may be the name or the key of the stream."""
    return _rendered((
        ("RECORD_SIZE", "rec_size"), ("CHECKSUM", checksum(event_body())), ("TIMESTAMP", F.unix_millis(F.col("ts").cast("timestamp"))), ("STREAM", stream), ("VERSION", "version"), ("SEQUENCE", "sequence"),
        ("TYPE_LENGTH", F.octet_length("type")), ("DATA_LENGTH", F.octet_length("data")), ("EVENT_TYPE", "type"), ("DATA_STRING", "data"),
    ))


def render_block(stream_hash=None, codec: str = "NONE") -> Column:
    """A block's header as text; its checksum is that of its events' sizes in order, its size that of header and entries."""
    key = F.xxhash64("stream") if stream_hash is None else _column(stream_hash)
    return _rendered((
        ("STREAM", "stream"), ("START_VERSION", "start_version"), ("ENTRIES", "entries"), ("UNCOMPRESSED_SIZE", "bytes"), ("BLOCK_SIZE", F.col("bytes") + BLOCK_HEADER_BYTES), ("STREAM_HASH", key),
        ("CHECKSUM", checksum(block_body())), ("CODEC", F.lit(codec)),
    ))


def block_body(stream="stream", start_version="start_version", entries="entries", size="bytes") -> Column:
    """The checksummed part of a block's header."""
    return F.encode(F.concat_ws("\x1f", *(_column(c).cast("string") for c in (stream, start_version, entries, size))), "UTF-8")


def event_json() -> Column:
    """An event as the HTTP read returns it: version, time in milliseconds, type and data.

    Data that is JSON stays what it is, in Spark's normal form; other data is a text, no data null.
    """
    data = F.coalesce(F.to_json(F.try_parse_json("data")), F.to_json(F.to_variant_object(F.array("data"))))
    plain = F.try_parse_json("data").isNull()
    text = F.when(plain, F.regexp_extract(data, r"(?s)^\[(.*)\]$", 1)).otherwise(data)
    head = F.to_json(F.struct("version", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "type"), {"ignoreNullFields": "false"})
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"data":'), F.when(F.col("data").isNull(), F.lit("null")).otherwise(text), F.lit("}"))


def segment_id_text(level="level", idx="idx") -> Column:
    """``LEVEL-IDX`` with 10 and 19 digits."""
    return F.concat(F.lpad(_column(level).cast("string"), 10, "0"), F.lit("-"), F.lpad(_column(idx).cast("string"), 19, "0"))


def parse_segment_id(text) -> tuple[Column, Column]:
    parts = F.split(_column(text), "-")
    return parts[0].cast("int"), parts[1].cast("long")


def is_flush(stream="stream", type="type") -> Column:
    return (_column(stream) == "_system") & (_column(type) == "FLUSH")


def is_blank(text) -> Column:
    return F.coalesce(F.length(F.trim(_column(text))) == 0, F.lit(True))


def require_not_blank(text) -> Column:
    """The text; an error if it is null or blank."""
    text = _column(text)
    return F.when(is_blank(text), F.raise_error(F.lit("blank text"))).otherwise(text)


def utf8_length(text) -> Column:
    return F.octet_length(F.encode(_column(text), "UTF-8"))


def max_value_of_bits(bits) -> Column:
    """The largest number that so many bits hold, for up to 62."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _column(bits).cast("int")) - 1


def decimal_digits(number) -> Column:
    return F.length(F.abs(_column(number)).cast("string"))


def bits_text(number, width: int = 32) -> Column:
    return F.lpad(F.bin(_column(number)), width, "0")


#: Size units in bytes.
UNITS = {name: 1024 ** (i + 1) for i, name in enumerate(("KB", "MB", "GB", "TB"))}


def size_of(amount, unit: str) -> Column:
    return (_column(amount) * F.lit(UNITS[unit])).cast("long")
