"""Sorted runs: merge, precedence, compaction; segments and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("stream", "version")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Events of all ``runs(stream, version, run, …)`` by key; of equal keys the later run first, all kept."""
    return runs.orderBy("stream", "version", F.desc("run"))


def precedence(runs: DataFrame) -> DataFrame:
    """One event for each key of ``runs(…, level, idx)``: that of the lowest level, there of the newest run.

    A maximum per key over (-level, idx, event) that is combined before the shuffle, so that keys
    with many copies meet in few rows.
    """
    rest = [c for c in runs.columns if c not in (*KEY, "level", "idx")]
    best = F.max(F.struct((-F.col("level")).alias("l"), F.col("idx"), *rest)).alias("best")
    return runs.groupBy(*KEY).agg(best).select(*KEY, (-F.col("best.l")).cast(runs.schema["level"].dataType).alias("level"), F.col("best.idx").alias("idx"), *(F.col(f"best.{c}").alias(c) for c in rest))


def compact(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Runs merged into one: a row for each key, ranged and sorted by it, ready to be written."""
    merged = precedence(runs).drop("level", "idx")
    ranged = merged.repartitionByRange(partitions, *KEY) if partitions else merged.repartitionByRange(*KEY)
    return ranged.sortWithinPartitions(*KEY)


def segment_order(segments: DataFrame, reverse: bool = False) -> DataFrame:
    """``segments(level, idx)`` with their place: level ascending, idx descending."""
    order = [F.col("level").desc(), F.col("idx").asc()] if reverse else [F.col("level").asc(), F.col("idx").desc()]
    return segments.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def view_head(segments: DataFrame) -> DataFrame:
    return segments.orderBy(F.asc("level"), F.desc("idx")).limit(1)


def view_tail(segments: DataFrame) -> DataFrame:
    return segments.orderBy(F.desc("level"), F.asc("idx")).limit(1)


def view_get(segments: DataFrame, place: int) -> DataFrame:
    return segment_order(segments).where(F.col("place") == place).drop("place")


def view_add(segments: DataFrame, added: DataFrame) -> DataFrame:
    return segments.unionByName(added)


def view_delete(segments: DataFrame, deleted: DataFrame) -> DataFrame:
    return segments.join(deleted.select("level", "idx"), ["level", "idx"], "left_anti")


def view_replace(segments: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    return view_add(view_delete(segments, deleted), added)


def level_segments(segments: DataFrame, level: int) -> DataFrame:
    return segments.where(F.col("level") == level)


def max_level(segments: DataFrame) -> DataFrame:
    return segments.agg(F.coalesce(F.max("level"), F.lit(0)).alias("max_level"))


def next_idx(segments: DataFrame, levels: DataFrame) -> DataFrame:
    """For each of ``levels(level)``: its largest idx and 1, or 0 if it is empty."""
    own = segments.groupBy("level").agg(F.max("idx").alias("last"))
    return levels.join(own, "level", "left").select("level", (F.coalesce("last", F.lit(-1).cast("long")) + 1).cast("long").alias("next_idx"))


def eligible(segments: DataFrame, compacting: DataFrame) -> DataFrame:
    """Segments that may be compacted: not being so already, and not the head."""
    return view_delete(view_delete(segments, compacting), view_head(segments))


def compaction_plan(segments: DataFrame, threshold: int = 2) -> DataFrame:
    """Groups of exactly ``threshold`` segments of a level, oldest first, without the head."""
    rest = view_delete(segments, view_head(segments))
    by_age = Window.partitionBy("level").orderBy("idx")
    grouped = rest.withColumn("batch", F.floor((F.row_number().over(by_age) - 1) / threshold).cast("int"))
    full = F.count(F.lit(1)).over(Window.partitionBy("level", "batch")) == threshold
    return grouped.withColumn("full", full).where("full").select("level", "batch", "idx")


def compaction_stats(inputs: DataFrame) -> DataFrame:
    """Of ``inputs(job, entries, bytes)``: sources, their bytes, and entries to expect (31 bits at most)."""
    return inputs.groupBy("job").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("bytes").cast("long").alias("source_bytes"), F.least(F.sum("entries"), F.lit(2147483647).cast("long")).cast("long").alias("expected_entries")
    )


def segment_state(log: DataFrame) -> DataFrame:
    """Live segments of ``log(pos, op, level, idx)``: those whose last operation adds them."""
    return log.groupBy("level", "idx").agg(F.max_by("op", "pos").alias("op")).where("op = 'ADD'").select("level", "idx")


def invalid_segment_ops(log: DataFrame) -> DataFrame:
    """Operations that add a live segment or delete one that isn't."""
    before = F.lag("op").over(Window.partitionBy("level", "idx").orderBy("pos"))
    return log.withColumn("before", before).where("op = coalesce(before, 'DELETE')").select("pos", "op", "level", "idx")
