"""Events as binary records: a fixed big-endian header, then the type and the data; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.events import checksum
from weftline.schema import HEADER_BYTES

#: The fields of the header with their bytes, in order.
HEADER = (("rec_size", 4), ("checksum", 4), ("stream_hash", 8), ("version", 4), ("sequence", 8), ("timestamp", 8), ("type_length", 2), ("data_length", 4))


def big_endian(number: Column, size: int) -> Column:
    """A whole number as so many bytes, in two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * size)))


def signed(data: Column, at: int, size: int) -> Column:
    """The number in ``size`` bytes from ``at`` (0 is the first)."""
    raw = F.conv(F.hex(F.substring(data, at + 1, size)), 16, -10 if size == 8 else 10).cast("long")
    return raw if size == 8 else F.when(raw >= 1 << 8 * size - 1, raw - (1 << 8 * size)).otherwise(raw)


def encode_event(stream_hash: str = "stream_hash", version: str = "version", sequence: str = "sequence", ts: str = "ts", type: str = "type", data: str = "data") -> Column:
    """The record of an event; its checksum covers all from the stream's hash on. Null if a part is."""
    kind, payload = F.encode(F.col(type), "UTF-8"), F.col(data).cast("binary")
    body = F.concat(
        big_endian(F.col(stream_hash), 8), big_endian(F.col(version), 4), big_endian(F.col(sequence), 8), big_endian(F.unix_millis(F.col(ts).cast("timestamp")), 8),
        big_endian(F.octet_length(kind), 2), big_endian(F.octet_length(payload), 4), kind, payload,
    )
    return F.concat(big_endian(F.octet_length(body) + 8, 4), big_endian(checksum(body), 4), body)


def decode_event(record: Column | str) -> Column:
    """A struct of the header's fields, ``ts``, ``type``, ``data`` (binary) and ``valid``.

    A record that is short, whose lengths contradict its size or whose checksum differs is not
    valid; its fields are then what stands in their places.
    """
    record = F.col(record) if isinstance(record, str) else record
    fields, at = {}, 0
    for name, size in HEADER:
        fields[name] = signed(record, at, size)
        at += size
    whole = (F.octet_length(record) == fields["rec_size"]) & (fields["type_length"] >= 0) & (fields["data_length"] >= 0) & (fields["rec_size"] == HEADER_BYTES + fields["type_length"] + fields["data_length"])
    same = fields["checksum"].bitwiseAND(0xFFFFFFFF) == checksum(F.substring(record, 9, 2147483647))
    kind = F.substring(record, F.lit(HEADER_BYTES + 1), fields["type_length"].cast("int"))
    payload = F.substring(record, (F.lit(HEADER_BYTES + 1) + fields["type_length"]).cast("int"), fields["data_length"].cast("int"))
    return F.struct(
        *(value.cast("int" if dict(HEADER)[name] < 8 else "long").alias(name) for name, value in fields.items()),
        F.timestamp_millis(fields["timestamp"]).alias("ts"), F.try_validate_utf8(kind.cast("string")).alias("type"), payload.alias("data"), F.coalesce(whole & same, F.lit(False)).alias("valid"),
    )


def to_bits(number, width: int) -> Column:
    """The lowest ``width`` bits of a number as booleans, lowest first."""
    number = F.col(number) if isinstance(number, str) else number
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(number, i) == 1)


def from_bits(bits) -> Column:
    """The number whose bits, lowest first, are the booleans of an array; 63 at most."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda total, bit: total * 2 + bit.cast("long"))
