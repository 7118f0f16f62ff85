"""Reads: pages, status, versions, ordered-key lookups, membership and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.events import is_flush
from weftline.schema import NO_DATA, NO_VERSION, PAGE, VERSION_TOO_HIGH

LOOKUPS = ("equals", "floor", "ceiling", "lower", "higher")


def log_scan(events: DataFrame, after: int | None = None) -> DataFrame:
    """All events in append order, or those after a sequence."""
    return (events if after is None else events.where(F.col("sequence") > after)).orderBy("sequence")


def key_scan(events: DataFrame, stream_hash: Column | None = None) -> DataFrame:
    """All events by the signed key of their stream, then by version: the order of a memtable's scan and of its index keys."""
    key = F.xxhash64("stream") if stream_hash is None else stream_hash
    return events.withColumn("stream_hash", key).orderBy("stream_hash", "version")


def read_page(events: DataFrame, stream: str, from_version: int = 0, limit: int = PAGE) -> DataFrame:
    """Up to ``limit`` events of a stream in order, from a version on, that one included."""
    return events.where((F.col("stream") == stream) & (F.col("version") >= from_version)).orderBy("version").limit(limit)


def stream_version(events: DataFrame) -> DataFrame:
    """The current version of every stream."""
    return events.groupBy("stream").agg(F.max("version").alias("version"))


def version_of(events: DataFrame, streams: DataFrame) -> DataFrame:
    """The current version of each of ``streams(stream)``; -1 if it has none."""
    known = stream_version(events.join(streams.select("stream").distinct(), "stream", "left_semi"))
    return streams.join(known, "stream", "left").select("stream", F.coalesce("version", F.lit(NO_VERSION)).alias("version"))


def read_status(events: DataFrame, probes: DataFrame) -> DataFrame:
    """For each ``probes(stream, version)``: 0, or why a read from there returns nothing."""
    current = version_of(events, probes.select("stream").distinct()).withColumnRenamed("version", "current")
    status = F.when(F.col("current") == NO_VERSION, NO_DATA).when(F.col("version") > F.col("current"), VERSION_TOO_HIGH).otherwise(0)
    return probes.join(current, "stream").select("stream", "version", status.cast("int").alias("status"))


def lookup(keys: DataFrame, probes: DataFrame, how: str) -> DataFrame:
    """For each ``probes(stream, version)`` the version of the same stream in ``keys`` that ``how`` asks for.

    ``found`` is null if there is none. Exact lookups are a join. The other four go over the union
    of both sides, sorted by version within a stream, and carry the last key along: one shuffle,
    and no pair of a probe and a key is ever made. A key with the probe's own version counts for
    floor and ceiling only.
    """
    if how not in LOOKUPS:
        raise ValueError(f"lookup must be one of {LOOKUPS}, not {how!r}")
    keys = keys.select("stream", "version").distinct()
    if how == "equals":
        return probes.join(keys.withColumn("found", F.col("version")), ["stream", "version"], "left").select("stream", "version", "found")
    down, inclusive = how in ("floor", "lower"), how in ("floor", "ceiling")
    both = keys.select("stream", "version", F.col("version").alias("key")).unionByName(probes.select("stream", "version", F.lit(None).cast("int").alias("key")).withColumn("probe", F.lit(True)), allowMissingColumns=True)
    first = F.col("key").isNull() if not inclusive else F.col("key").isNotNull()
    order = [F.col("version").asc() if down else F.col("version").desc(), first.desc()]
    carried = F.last("key", ignorenulls=True).over(Window.partitionBy("stream").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("found", carried).where("probe").select("stream", "version", "found")


def members(probes: DataFrame, events: DataFrame) -> DataFrame:
    """The probes whose (stream, version) is there; exact."""
    return probes.join(events.select("stream", "version"), ["stream", "version"], "left_semi")


def of_types(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("type").isin(*types))


def flush_events(events: DataFrame) -> DataFrame:
    return events.where(is_flush())


def filtered(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def mapped(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(name) for name, c in columns.items()))
