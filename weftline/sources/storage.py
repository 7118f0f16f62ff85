"""Logs and runs as Parquet, and dumps as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.events import render_block, render_event, render_record
from weftline.operators.blocks import pack_blocks, with_blocks
from weftline.operators.lsm import KEY
from weftline.operators.ops import dump_summary
from weftline.schema import BLOCK_BYTES

#: Level from which runs are packed tighter.
HIGH_LEVEL = 4
#: Block codecs of the store and what Parquet has for them. LZ4 is written as Snappy, a codec of its
#: kind: a run that Spark wrote as ``lz4_raw`` could not be read back ("last 5 bytes must be literals").
CODECS = {"NONE": "none", "SNAPPY": "snappy", "LZ4_HIGH": "zstd", "LZ4": "snappy", "ZLIB": "gzip"}


def compression(level: int) -> str:
    return CODECS["ZLIB" if level >= HIGH_LEVEL else "LZ4"]


def append_log(events: DataFrame, path: str, segment_rows: int = 0) -> None:
    """Appends events to a log; files roll over after ``segment_rows`` rows, if that is not 0."""
    events.write.mode("append").option("maxRecordsPerFile", segment_rows).parquet(path)


def write_run(events: DataFrame, path: str, level: int = 0, partitions: int | None = None) -> None:
    """Writes one sorted run: files are ranged by (stream, version), so their statistics prune reads."""
    ranged = events.repartitionByRange(partitions, *KEY) if partitions else events.repartitionByRange(*KEY)
    ranged.sortWithinPartitions(*KEY).write.mode("overwrite").option("compression", compression(level)).option("parquet.bloom.filter.enabled#stream", "true").parquet(path)


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_runs(spark: SparkSession, runs: list[tuple[str, int, int]]) -> DataFrame:
    """Runs (path, level, idx) as one table with both numbers."""
    parts = [spark.read.parquet(path).withColumn("level", F.lit(level)).withColumn("idx", F.lit(idx).cast("long")) for path, level, idx in runs]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "stream string, version int, sequence long, ts timestamp, type string, data string, rec_size int")


def dump_text(events: DataFrame, path: str) -> None:
    """Writes events as lines of text; those without a time have ``null`` there."""
    if "ts" not in events.columns:
        events = events.withColumn("ts", F.lit(None).cast("timestamp"))
    events.select(render_event().alias("value")).write.mode("overwrite").text(path)


def dump_blocks(events: DataFrame, path: str, budget: int = BLOCK_BYTES) -> None:
    """Writes events as text: each block's header and its events, by stream and version, then the totals."""
    blocks = pack_blocks(events, budget)
    heads = blocks.select("stream", "start_version", F.lit(None).cast("int").alias("version"), F.concat(F.lit("----- "), render_block()).alias("value"))
    rows = with_blocks(events, budget).select("stream", "version", "start_version").join(events, list(KEY)).select("stream", "start_version", "version", render_record().alias("value"))
    total = dump_summary(blocks).select(F.concat(F.lit("TOTAL_BLOCKS: "), F.col("blocks"), F.lit(", TOTAL_ENTRIES: "), F.coalesce("entries", F.lit(0))).alias("value"))
    every = heads.unionByName(rows).unionByName(total, allowMissingColumns=True)
    every.orderBy(F.asc_nulls_last("stream"), "start_version", F.asc_nulls_first("version")).select("value").write.mode("overwrite").text(path)
