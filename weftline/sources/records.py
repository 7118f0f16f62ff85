"""Files of length-prefixed records: a 4-byte big-endian size, itself included, then the body.

``read_records`` reads any file system that Spark does; the data source ``records`` reads paths
that every executor can open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def records(data: bytes, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, body) of each record; ends at the first short or broken one."""
    while start + 4 <= len(data):
        (size,) = struct.unpack_from(">i", data, start)
        if size < 4 or start + size > len(data):
            return
        yield start, data[start + 4 : start + size]
        start += size


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], start: int):
        self.paths, self.start = paths, start

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as file:
            data = file.read()
        for offset, body in records(data, self.start):
            yield partition.path, offset, body


class RecordSource(DataSource):
    """``spark.read.format("records").option("paths", "a,b").load()``; a segment file is a task."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "file string, offset long, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["paths"].split(",") if p], int(self.options.get("start", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)


def _split(batches: Iterator[pa.RecordBatch], start: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for some in batched(records(content.as_py(), start), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array([o for o, _ in some], pa.int64()), pa.array([b for _, b in some], pa.binary())], ["file", "offset", "body"])


def read_records(spark: SparkSession, *paths: str, start: int = 0) -> DataFrame:
    """(file, offset, body) of files that a segment's size bounds, well under 2 GB each; one file is one task's."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(partial(_split, start=start), "file string, offset long, body binary")


def read_events(spark: SparkSession, *paths: str, start: int = 0) -> DataFrame:
    """Events of binary log segments: (file, offset) and the fields of ``decode_event``."""
    from weftline.functions.codec import big_endian, decode_event

    found = read_records(spark, *paths, start=start)
    record = F.concat(big_endian(F.octet_length("body") + 4, 4), "body")
    return found.select("file", "offset", decode_event(record).alias("event")).select("file", "offset", "event.*")
