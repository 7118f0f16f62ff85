"""Hashes and checksums that Spark has no built-in function for, as Arrow-batched UDFs."""

from __future__ import annotations

import zlib

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STREAM_SEED, _MURMUR_SEED = 0x9747B28C, 104729
_M32 = 0xFFFFFFFF


def _rotated(x: int, by: int) -> int:
    return (x << by | x >> 32 - by) & _M32


def murmur3_32(data: bytes, seed: int = _MURMUR_SEED, signed_tail: bool = False) -> int:
    """MurmurHash3 x86 32; with ``signed_tail`` the last bytes are read as signed ones."""
    h = seed
    whole = len(data) & ~3
    mix = lambda k: _rotated(k * 0xCC9E2D51 & _M32, 15) * 0x1B873593 & _M32
    for i in range(0, whole, 4):
        h = (_rotated(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & _M32
    k = 0
    for i, byte in reversed(list(enumerate(data[whole:]))):
        k ^= ((byte - 256 if signed_tail and byte > 127 else byte) << 8 * i) & _M32
    if len(data) > whole:
        h ^= mix(k)
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M32
    return h ^ h >> 16


_M64 = (1 << 64) - 1
#: The published constants of MurmurHash3 x64.
_C1, _C2, _N1, _N2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729, 0x38495AB5


def _rotated64(x: int, by: int) -> int:
    return (x << by | x >> 64 - by) & _M64


def _final64(h: int) -> int:
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & _M64
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & _M64
    return h ^ h >> 33


def _lane(data: bytes, first: int, by: int, second: int) -> int:
    """Up to eight bytes as one mixed number; none give 0, which changes nothing."""
    return _rotated64(int.from_bytes(data, "little") * first & _M64, by) * second & _M64


def murmur3_64(data: bytes, seed: int = _MURMUR_SEED) -> int:
    """One lane of MurmurHash3 x64, as a 64-bit hash of its own."""
    h = seed
    whole = len(data) & ~7
    for i in range(0, whole, 8):
        h = (_rotated64(h ^ _lane(data[i : i + 8], _C1, 31, _C2), 27) * 5 + _N1) & _M64
    return _final64(h ^ _lane(data[whole:], _C1, 31, _C2) ^ len(data))


def murmur3_128(data: bytes, seed: int = _MURMUR_SEED) -> tuple[int, int]:
    """MurmurHash3 x64 128."""
    a = b = seed
    whole = len(data) & ~15
    for i in range(0, whole, 16):
        a = ((_rotated64(a ^ _lane(data[i : i + 8], _C1, 31, _C2), 27) + b) * 5 + _N1) & _M64
        b = ((_rotated64(b ^ _lane(data[i + 8 : i + 16], _C2, 33, _C1), 31) + a) * 5 + _N2) & _M64
    a ^= _lane(data[whole : whole + 8], _C1, 31, _C2) ^ len(data)
    b ^= _lane(data[whole + 8 :], _C2, 33, _C1) ^ len(data)
    a = (a + b) & _M64
    b = (a + b) & _M64
    a, b = _final64(a), _final64(b)
    a = (a + b) & _M64
    return a, (a + b) & _M64


def stream_key(name: str) -> int:
    """The signed 64-bit key of a stream name: xxHash32 above, murmur3 below."""
    data = name.encode()
    key = xxhash.xxh32_intdigest(data, _STREAM_SEED) << 32 | murmur3_32(data, signed_tail=True)
    return key - (1 << 64) if key >> 63 else key


def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC32C = _crc32c_table()


def crc32c(data: bytes) -> int:
    crc = _M32
    for byte in data:
        crc = crc >> 8 ^ _CRC32C[(crc ^ byte) & 255]
    return crc ^ _M32


@F.pandas_udf(T.LongType())
def stream_key_udf(names: pd.Series) -> pd.Series:
    """Keys of a batch of stream names, each distinct name hashed once; null stays null."""
    keys = {n: stream_key(n) for n in names.dropna().unique()}
    return names.map(keys).astype("Int64")


@F.pandas_udf(T.LongType())
def crc32c_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else crc32c(x)).astype("Int64")


@F.pandas_udf(T.LongType())
def adler32_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.adler32(x)).astype("Int64")


def _as_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.LongType())
def xxhash32_udf(data: pd.Series) -> pd.Series:
    """xxHash32 of bytes, unsigned, with the seed of stream keys. Spark's own ``xxhash64`` has another seed."""
    return data.map(lambda x: None if x is None else xxhash.xxh32_intdigest(x, _STREAM_SEED)).astype("Int64")


@F.pandas_udf(T.LongType())
def xxhash64_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else _as_signed(xxhash.xxh64_intdigest(x, _STREAM_SEED))).astype("Int64")


@F.pandas_udf(T.LongType())
def murmur3_64_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else _as_signed(murmur3_64(x))).astype("Int64")


@F.pandas_udf(T.BinaryType())
def murmur3_128_udf(data: pd.Series) -> pd.Series:
    """16 bytes, both halves big-endian."""
    return data.map(lambda x: None if x is None else b"".join(h.to_bytes(8) for h in murmur3_128(x)))
