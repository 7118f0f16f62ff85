"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import checkpointed, read_table, row_count

#: Code points whose class (letter, digit, blank, other) is the same in ``re`` and in the tokenizers.
_RANGES = ((0x20, 0x7E), (0xA1, 0x2AF), (0x386, 0x3CE), (0x400, 0x513), (0x5D0, 0x5EA), (0x621, 0x64A), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20B5), (0x3001, 0x3003), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E))
_PLAIN = "".join(
    chr(c) for first, last in _RANGES for c in range(first, last + 1)
    if unicodedata.category(chr(c)) != "Cn" and (unicodedata.category(chr(c))[0] == "N") == chr(c).isdecimal() and not (chr(c).isspace() and c != 0x20)
)
_UNUSUAL = re.compile(f"[^\t\n\r{re.escape(_PLAIN)}]")
#: Blanks so long that the fast way's pattern would go back over them; such texts go the plain way.
_LONG_BLANKS = re.compile(r"\s{5000}")


@lru_cache(maxsize=2)
def encoder(name: str):
    """``text -> ids`` of the byte-level BPE ``name``.json, as little-endian 32-bit integers.

    The same ids as the tokenizer file gives with ``add_special_tokens=False``, found faster: texts
    of usual characters are cut by the same pattern and encoded with the same vocabulary's ranks;
    others, and those with a special token's string, go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))  # for most texts it is not needed
    with open(public_tokenizers.path(f"{name}.json")) as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if _UNUSUAL.search(text) or any(s in text for s in special) or _LONG_BLANKS.search(text):
            return np.array(slow().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
    for whole in batches:
        for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            row, start, length, total, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                own = encode(text.as_py() or "") + end
                n = len(own) // 4
                for at in range(0, n, capacity):
                    row.append(i)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    total.append(n)
                    ids.append(own[4 * at : 4 * (at + capacity)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(ids, pa.binary())],
                ["id", "start", "length", "doc_tokens", "ids"],
            )


def cut_pieces(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """``(<id_col>, start, length, doc_tokens, ids)``: documents as tokens, cut into full windows and a rest.

    ``ids`` holds little-endian unsigned 32-bit integers. Each document ends with ``end_id``, so
    that a null or empty text has one token. A document of at most ``capacity`` tokens is one
    piece. Repeated rows and repeated ids are documents of their own; ids may be null; extra
    columns are left out; an empty table has no pieces.
    """
    plain = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")), T.StructField("ids", T.BinaryType())])
    return plain.mapInArrow(partial(_cut, tokenizer=tokenizer, capacity=capacity, end_id=end_id), schema).withColumnRenamed("id", id_col)


class OpenWindows:
    """Windows by remaining capacity, with a segment tree of how many have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += change
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """(room, window) with the least room of ``length`` or more."""
        i = length + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; equal lengths go in the order given."""
    windows, offsets, n = [0] * len(lengths), [0] * len(lengths), 0
    free = OpenWindows(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take_tightest(lengths[i])
        if found is None:
            found, n = (capacity, n), n + 1
        room, windows[i] = found
        offsets[i] = capacity - room
        if room > lengths[i]:
            free.put(room - lengths[i], windows[i])
    return windows, offsets


def _place(key: tuple, table: pa.Table, capacity: int) -> pa.Table:
    group = key[0].as_py()
    table = table.drop_columns(["__group"])
    windows, offsets = best_fit_decreasing(table["length"].to_pylist(), capacity)
    return table.append_column("sequence_id", pa.array(np.array(windows, np.int64) + (group << 32))).append_column("offset", pa.array(offsets, pa.int64()))


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", capacity: int = 2048, per_group: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each one lies.

    Pieces are dealt at random into groups of about ``per_group``, which are packed apart: the
    last windows of a group may stay open, a few thousandths of its tokens, and no group grows
    with the input, however alike its pieces are: a number fixed with the stored pieces deals them
    too. All columns are kept, but for own ones of those two names. ``length`` must be
    from 1 to ``capacity``.
    """
    pieces = checkpointed(pieces.drop("sequence_id", "offset").withColumn("__salt", F.monotonically_increasing_id()))
    groups = max(1, -(-row_count(pieces) // per_group))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(id_col, "start", "doc_tokens", "__salt"), F.lit(groups))).drop("__salt")
    schema = T.StructType([*(f for f in pieces.schema.fields if f.name != "__salt"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("__group").applyInArrow(lambda key, table: _place(key, table, capacity), schema)


def packed_digests(documents: DataFrame) -> DataFrame:
    """Packed pieces of ``documents`` with a CRC-32 of their ids in place of the ids.

    Null and empty texts are one piece of one token; null and repeated ids, repeated rows, extra
    columns and an empty table as in ``cut_pieces`` and ``pack_pieces``.
    """
    pieces = cut_pieces(documents).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack_pieces(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, packed; odd rows as in ``packed_digests``."""
    return packed_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
SQL: dict = {}
