"""The event envelope: columns, sentinels, and the driver's ``events`` table seen as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Version of a stream that has none, and "any version" on append.
NO_VERSION = -1
#: Read status: the version asked for is beyond the stream's current one.
VERSION_TOO_HIGH = -22
#: Read status: the stream is not there.
NO_DATA = -11
#: Last sequence of an empty log.
NO_SEQUENCE = -1
#: Events that one read returns at most, if it does not say otherwise.
PAGE = 1000
#: Bytes of an event before its type and its data.
HEADER_BYTES = 42
BLOCK_BYTES = 8192
SYSTEM_STREAM, FLUSH_TYPE = "_system", "FLUSH"
EVENT_COLUMNS = ("stream", "version", "sequence", "ts", "type", "data", "rec_size")


def rec_size(type_col: str = "type", data_col: str = "data"):
    return (F.lit(HEADER_BYTES) + F.octet_length(type_col) + F.octet_length(data_col)).cast("int")


def from_events_table(events: DataFrame) -> DataFrame:
    """Events of the driver's table: a stream for each user, versions by event id."""
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("int").alias("version"),
        F.col("event_id").alias("sequence"),
        "ts",
        F.col("event_type").alias("type"),
        F.col("props").alias("data"),
        rec_size("event_type", "props").alias("rec_size"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events_table(spark.read.parquet(f"{sf_dir}/events.parquet"))
