"""Sequence operators and small aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concat(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, each with the number of its part."""
    return reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))


#: Concatenates too; there is no interleaving.
round_robin = concat


def batching(rows: DataFrame, size: int, by: str, order: str) -> DataFrame:
    """Consecutive rows in batches of ``size``, numbered from 0 within ``by``; the last may be short."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("long"))


def buffering(rows: DataFrame, size: int = 0) -> DataFrame:
    """The same rows; Spark reads ahead by itself."""
    return rows


def peeking(events: DataFrame, column: str = "version") -> DataFrame:
    """Each event with the next one's ``column`` in its stream, null at the end."""
    return events.withColumn("peek", F.lead(column).over(Window.partitionBy("stream").orderBy("version")))


def cycle(rows: DataFrame, times: int) -> DataFrame:
    """The rows over and over, ``times`` times."""
    return rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else rows.withColumn("round", F.lit(0)).where(F.lit(False))


def gap_check(events: DataFrame) -> DataFrame:
    """Events that do not follow on the version before them in their stream."""
    before = F.lag("version").over(Window.partitionBy("stream").orderBy("version"))
    return events.withColumn("before", before).where(F.col("version") - F.col("before") > 1).select("stream", "version", "before")


def renumbered(events: DataFrame) -> DataFrame:
    """Contiguous versions by sequence within each stream."""
    return events.withColumn("version", (F.row_number().over(Window.partitionBy("stream").orderBy("sequence")) - 1).cast("int"))


def table_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("entries"), F.sum("rec_size").cast("long").alias("bytes"), F.count_distinct("stream").alias("streams"))


def dump_summary(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("entries").cast("long").alias("entries"), F.sum("bytes").cast("long").alias("bytes"))


def metrics_merge(*metrics: DataFrame) -> DataFrame:
    """Sums by name of any number of ``(name, value)``."""
    return reduce(DataFrame.unionByName, metrics).groupBy("name").agg(F.sum("value").cast("long").alias("value"))


def metric(metrics: DataFrame, name: str) -> DataFrame:
    """The value of one metric, 0 if there is none."""
    return metrics.where(F.col("name") == name).agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))


def json_extract(events: DataFrame, path: str = "$.k") -> DataFrame:
    return events.select("stream", "version", F.get_json_object("data", path).alias("value"))


def json_encoded(events: DataFrame, *columns: str) -> DataFrame:
    return events.select("stream", "version", F.to_json(F.struct(*columns)).alias("json"))
