"""Blocks: consecutive events of one stream that are stored and read together."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.codec import decode_event, encode_event
from weftline.functions.codecs import known, pack, unpack
from weftline.functions.events import CHECKSUM_SEED, checksum
from weftline.operators.folds import blocks_within
from weftline.schema import BLOCK_BYTES
from weftline.sources.records import records


def with_blocks(events: DataFrame, budget: int = BLOCK_BYTES) -> DataFrame:
    """(stream, version, rec_size, start_version): each event with its block's first version.

    A block is cut where the next event would take it past ``budget`` bytes; an event larger than
    that is a block of its own.
    """
    ordered = events.select("stream", "version", "rec_size").repartition("stream").sortWithinPartitions("stream", "version")
    return ordered.mapInArrow(blocks_within(budget), "stream string, version int, rec_size int, start_version int")


def pack_blocks(events: DataFrame, budget: int = BLOCK_BYTES) -> DataFrame:
    """(stream, start_version, entries, bytes): the sparse index of blocks."""
    return with_blocks(events, budget).groupBy("stream", "start_version").agg(F.count(F.lit(1)).cast("int").alias("entries"), F.sum("rec_size").cast("long").alias("bytes"))


def block_bodies(events: DataFrame, budget: int = BLOCK_BYTES) -> DataFrame:
    """Blocks with their events in order; a block is bounded by its budget."""
    cut = with_blocks(events, budget).select("stream", "version", "start_version")
    return events.join(cut, ["stream", "version"]).groupBy("stream", "start_version").agg(F.sort_array(F.collect_list(F.struct("version", "sequence", "type", "data", "rec_size"))).alias("events"))


def explode_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select("stream", "start_version", F.inline("events"))


def read_block(blocks: DataFrame, stream: str, version: int) -> DataFrame:
    """The block that holds a version; it may start before it."""
    return blocks.where((F.col("stream") == stream) & (F.col("start_version") <= version) & (version < F.col("start_version") + F.col("entries")))


def index_counts(blocks: DataFrame) -> DataFrame:
    """Blocks (sparse entries) and events (dense entries) of each stream."""
    return blocks.groupBy("stream").agg(F.count(F.lit(1)).alias("sparse_entries"), F.sum("entries").cast("long").alias("dense_entries"))


STORED = "stream string, start_version int, entries int, bytes long, codec string, checksum long, body binary"


def stored_blocks(events: DataFrame, budget: int = BLOCK_BYTES, codec: str = "LZ4", stream_hash: Column | None = None) -> DataFrame:
    """Blocks as they are kept: header, codec, checksum of the plain body, and the compressed records of their events."""
    known(codec)
    key = F.xxhash64("stream") if stream_hash is None else stream_hash
    cut = with_blocks(events, budget).select("stream", "version", "start_version")
    records = events.withColumn("stream_hash", key).select("stream", "version", encode_event().alias("record")).join(cut, ["stream", "version"])
    body = F.aggregate(F.sort_array(F.collect_list(F.struct("version", "record"))), F.lit(b""), lambda whole, e: F.concat(whole, e["record"]))
    blocks = records.groupBy("stream", "start_version").agg(F.count(F.lit(1)).cast("int").alias("entries"), body.alias("plain"))
    plain = blocks.select("stream", "start_version", "entries", F.octet_length("plain").cast("long").alias("bytes"), F.lit(codec).alias("codec"), checksum("plain").alias("checksum"), F.col("plain").alias("body"))
    return plain.mapInArrow(partial(_packed, codec=codec), STORED)


#: Plain bytes of blocks that a step in Python makes before it hands them on; a larger block goes alone.
PART_BYTES = 1 << 20
_SEEDED = zlib.crc32(CHECKSUM_SEED)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``STORED`` in parts of ``PART_BYTES`` at most by their ``bytes``, which may be null or wrong."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(batch.column(3).to_pylist()):
            size = min(max(size or 0, 0), PART_BYTES)
            if held + size > PART_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def _packed(batches: Iterator[pa.RecordBatch], codec: str) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        bodies = [None if plain is None else pack(plain, codec) for plain in (x.as_py() for x in part.column(6))]
        yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(bodies, pa.binary())], part.schema.names)


def _plain(part: pa.RecordBatch) -> Iterator[bytes | None]:
    """Each block's plain body, one at a time; None if it isn't of its size, its checksum and its count of events."""
    for entries, size, codec, check, body in zip(*(part.column(i) for i in range(2, 7)), strict=True):
        try:
            plain = unpack(body.as_py(), codec.as_py(), size.as_py())
        except (ValueError, OSError, zlib.error, TypeError):  # bytes that the codec can't read, or a null
            plain = None
        yield plain if plain is not None and zlib.crc32(plain, _SEEDED) == check.as_py() and sum(1 for _ in records(plain)) == entries.as_py() else None


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([plain is not None for plain in _plain(part)], pa.bool_())], ["stream", "start_version", "valid"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        found = [[plain[at : at + 4 + len(own)] for at, own in records(plain or b"")] for plain in _plain(part)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.binary()))], ["stream", "start_version", "records"])


def _stored(blocks: DataFrame) -> DataFrame:
    return blocks.select(*(field.split()[0] for field in STORED.split(", ")))


def block_valid(blocks: DataFrame) -> DataFrame:
    """(stream, start_version, valid): whether a stored block unpacks to its size, its checksum and its count of events."""
    return _stored(blocks).mapInArrow(_judged, "stream string, start_version int, valid boolean")


def stored_events(blocks: DataFrame) -> DataFrame:
    """Events of stored blocks that are valid, with the fields of ``decode_event``."""
    found = _stored(blocks).mapInArrow(_unpacked, "stream string, start_version int, records array<binary>")
    return found.select("stream", "start_version", F.explode("records").alias("record")).select("stream", "start_version", decode_event("record").alias("event")).select("stream", "start_version", "event.*")
