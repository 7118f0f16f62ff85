"""Structured Streaming: tailing a log, appends by micro-batch, dispatch by type, versions as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from weftline.operators.append import append_any


def tail(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A log as a stream: each event once; the checkpoint of the query is where it goes on."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def run_available(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there now to ``target`` and ends; the next call goes on after it."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return query


def append_batches(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Appends ``stream(stream, pos, type, data)`` to a log, versioned batch by batch.

    A batch writes a folder of its own, so that one which is run again replaces what it wrote, and
    beside the log, in ``<log>-versions``, the last version of every stream: the next batch joins its
    streams with that one table and reads no earlier event. Tables older than two batches go.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "stream string, version int"
        before = spark.read.schema(schema).parquet(f"{log}-versions/batch={number - 1}") if number else spark.createDataFrame([], schema)
        append_any(before, batch).select("stream", "version", "pos", "type", "data").write.mode("overwrite").parquet(f"{log}/batch={number}")
        written = spark.read.schema(schema).parquet(f"{log}/batch={number}")
        last = before.unionByName(written).groupBy("stream").agg(F.max("version").alias("version"))
        last.write.mode("overwrite").parquet(f"{log}-versions/batch={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{log}-versions/batch={number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dispatch(stream: DataFrame, handlers: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Each handler gets the events of its type, batch by batch."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for kind, handler in handlers.items():
                handler(batch.where(F.col("type") == kind), number)
        finally:
            batch.unpersist()

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version = state.get[0] if state.exists else -1
    rows = pd.concat(list(batches)).sort_values("sequence")
    rows["version"] = range(version + 1, version + 1 + len(rows))
    state.update((version + len(rows),))
    yield rows[["stream", "sequence", "version"]].astype({"version": "int32"})


def versioned(stream: DataFrame) -> DataFrame:
    """(stream, sequence, version): the version counter of each stream is kept as state."""
    return stream.groupBy("stream").applyInPandasWithState(_number, "stream string, sequence long, version int", "version int", "append", GroupStateTimeout.NoTimeout)
