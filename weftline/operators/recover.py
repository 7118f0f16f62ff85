"""Recovery: what a log holds after its last flush, and its valid prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.events import is_flush, is_valid
from weftline.schema import NO_SEQUENCE


def last_flush(events: DataFrame, flush: Column | None = None) -> DataFrame:
    flush = is_flush() if flush is None else flush
    return events.agg(
        F.coalesce(F.max(F.when(flush, F.col("sequence"))), F.lit(NO_SEQUENCE).cast("long")).alias("last_flush"), F.coalesce(F.max("sequence"), F.lit(NO_SEQUENCE).cast("long")).alias("last_sequence")
    )


def to_replay(events: DataFrame, flush: Column | None = None) -> DataFrame:
    """Events after the last flush; all if there was none."""
    return events.where(F.col("sequence") > last_flush(events, flush).select("last_flush").scalar())


def valid_events(events: DataFrame) -> DataFrame:
    return events.where(is_valid())


def valid_prefix(records: DataFrame, valid: Column | str = "valid", order: str = "pos") -> DataFrame:
    """Records before the first invalid one: its place is one minimum, not a sorted scan."""
    valid = F.col(valid) if isinstance(valid, str) else valid
    cut = records.agg(F.min(F.when(~F.coalesce(valid, F.lit(False)), F.col(order))).alias("cut"))
    cut = cut.scalar()
    return records.where(cut.isNull() | (F.col(order) < cut))
