"""Compression of bytes by the store's codecs, as Arrow-batched UDFs over whole columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codecs by name; LZ4 is the block format without a frame, LZ4_HIGH the same written with more effort.
NAMES = ("NONE", "SNAPPY", "LZ4", "LZ4_HIGH", "ZLIB")
_ARROW = {"SNAPPY": "snappy", "LZ4": "lz4_raw", "LZ4_HIGH": "lz4_raw"}


@lru_cache(maxsize=8)
def _arrow(name: str) -> pa.Codec:
    return pa.Codec(_ARROW[name], compression_level=12 if name == "LZ4_HIGH" else None)


def pack(data: bytes, name: str) -> bytes:
    if name == "NONE":
        return data
    return zlib.compress(data) if name == "ZLIB" else _arrow(name).compress(data, asbytes=True)


def unpack(data: bytes, name: str, size: int) -> bytes:
    """The ``size`` bytes that ``data`` holds; an error if it holds others."""
    found = data if name == "NONE" else zlib.decompress(data) if name == "ZLIB" else _arrow(name).decompress(data, size, asbytes=True) if size else b""
    if len(found) != size:
        raise ValueError(f"{name} data of {len(found)} bytes, not {size}")
    return found


def known(name: str) -> str:
    if name not in NAMES:
        raise ValueError(f"codec must be one of {NAMES}, not {name!r}")
    return name


def compressed(name: str) -> Callable[[Column | str], Column]:
    """A function of a binary column; null stays null."""
    known(name)

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else pack(bytes(x), name))

    return run


def decompressed(name: str) -> Callable[[Column | str, Column | str], Column]:
    """A function of a binary column and one with the sizes before compression; null stays null."""
    known(name)

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unpack(bytes(x), name, int(n)) for x, n in zip(data, size, strict=True)])

    return run
