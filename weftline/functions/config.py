"""Typed settings: the session's before the environment's before a properties file's."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

Value = TypeVar("Value")


def properties(spark: SparkSession, path: str) -> dict[str, str]:
    """``key=value`` lines of a small file, wherever Spark reads; blank lines and those with ``#`` are left out."""
    lines = (r["value"].strip() for r in spark.read.text(path).collect())
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in lines if line and not line.startswith("#"))}


def setting(spark: SparkSession, key: str, default: Value = None, kind: Callable[[str], Value] = str, file: dict[str, str] | None = None) -> Value:
    """The value of ``key`` as ``kind``; in the environment its dots are underscores and its letters upper case."""
    found = spark.conf.get(key, None)
    if found is None:
        found = os.environ.get(key.replace(".", "_").upper(), (file or {}).get(key))
    if found is None:
        return default
    return kind(found) if kind is not bool else found.strip().lower() == "true"
