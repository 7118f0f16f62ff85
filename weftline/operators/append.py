"""Appends with and without an expected version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.events import checksum, event_body
from weftline.operators.folds import accepted_versions
from weftline.operators.read import version_of
from weftline.plans.lineage import checkpointed
from weftline.schema import NO_SEQUENCE


def append_any(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming(stream, pos, …)`` with ``version``: each stream goes on where it stands in ``current``."""
    known = version_of(current, incoming.select("stream").distinct()).withColumnRenamed("version", "current")
    numbered = incoming.withColumn("nth", F.row_number().over(Window.partitionBy("stream").orderBy("pos")))
    return numbered.join(known, "stream").withColumn("version", (F.col("current") + F.col("nth")).cast("int")).drop("current", "nth")


def append_expected(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(stream, pos, expected, ok, version) for ``incoming(stream, pos, expected)``.

    In order of pos, an event is accepted if it expects -1 or the stream's next version; a
    rejected one has no version and does not count. Accepted events are seen by later ones.
    """
    known = version_of(current, incoming.select("stream").distinct()).withColumnRenamed("version", "current")
    ordered = incoming.select("stream", "pos", "expected").join(known, "stream").repartition("stream").sortWithinPartitions("stream", "pos")
    kind = incoming.schema["pos"].dataType.simpleString()
    return ordered.mapInArrow(accepted_versions, f"stream string, pos {kind}, expected int, ok boolean, version int")


def stamped(accepted: DataFrame, last_sequence: int = NO_SEQUENCE, order: str = "pos") -> DataFrame:
    """Accepted events with a dense sequence after ``last_sequence``, a timestamp and a checksum.

    Positions within range partitions are numbered in parallel; only one count for each partition
    comes together.
    """
    # kept, since both the counts and the numbers read it: ranges drawn twice could differ
    ranged = checkpointed(accepted.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ranged.join(base, "part").withColumn("sequence", (F.col("base") + own + last_sequence).cast("long")).withColumn("ts", F.current_timestamp()).withColumn("checksum", checksum(event_body())).drop("part", "base")
