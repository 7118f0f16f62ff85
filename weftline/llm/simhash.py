"""SimHash near-duplicates: equal bit bands, pivot distance tables, then verified distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import checkpointed, own_columns, read_table, whole_row
from weftline.llm.components import components, spanning_labels

#: Reference fingerprints, the same in every task.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(64)], np.uint64)
#: Pairs that are looked at together.
_PAIRS = 1 << 21


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of a text in UTF-8: A-Z lowered, shingles of ``width`` words, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends[: len(words) - width + 1] - [len(w) + 1 for w in words[: len(words) - width + 1]]).tolist()
        joined = b" ".join(words)
        hashes = list(map(xxhash.xxh64_intdigest, [joined[i:j] for i, j in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], repeat(42)))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py(), width) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "digest", "fp"])


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row of Hamming distances to the pivots for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int16).reshape(len(fp), len(pivots))


def close_pairs(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the pairs (a[i], b[i]) those within ``bits``, and how many the pivots left to verify.

    A pair's distance is at least the difference of its distances to any pivot, so pairs whose
    largest difference is over ``bits`` go; what is left is verified.
    """
    for pivot in range(table.shape[1]):
        near = np.abs(table[a, pivot] - table[b, pivot]) <= bits
        a, b = a[near], b[near]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[near], b[near], len(a)


class Selection(NamedTuple):
    """Pairs within the buckets, those within reach at the first pivot, those that no pivot discards, and links."""

    pairs: int
    listed: int
    left: int
    links: int


def _within_groups(rows: dict[str, np.ndarray], bits: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, Selection]:
    """Links of rows that are sorted by group; whole groups only.

    Members of a group are sorted by their distance to the first pivot, and only those within
    ``bits`` of each other there are listed as pairs; the other pivots then discard.
    """
    n = len(rows["fp"])
    fp = rows["fp"].view(np.uint64)
    table = pivot_table(fp, pivots)
    first = np.ones(n, bool)
    first[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("band", "key", "low", "high")], axis=0)
    group = np.cumsum(first) - 1
    distance = table[:, 0].astype(np.int64) if len(pivots) else np.zeros(n, np.int64)
    place = group * 256 + distance  # distances and bits stay under 256, so no reach goes into the next group
    order = np.argsort(place, kind="stable")
    place = place[order]
    count = np.searchsorted(place, place + bits, side="right") - np.arange(n) - 1
    sizes = np.bincount(group)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    left, begin, upto = 0, 0, np.cumsum(count)
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _PAIRS, side="right")))
        own = count[begin:end]
        a = np.repeat(np.arange(begin, end), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        a, b = order[a], order[b]
        # blocks of one bucket meet in a group of their own, where only pairs across them count
        across = (rows["block"][a] != rows["block"][b]) | (rows["low"][a] == rows["high"][a])
        a, b, some = close_pairs(fp, table, a[across], b[across], bits)
        found.append((a, b))
        left += some
        begin = end
    a, b = (np.concatenate([p[i] for p in found]) if found else np.array([], np.int64) for i in (0, 1))
    return a, b, Selection(int((sizes * (sizes - 1) // 2).sum()), int(count.sum()), left, len(a))


def _links(batches: Iterator[pa.RecordBatch], bits: int, pivots: np.ndarray, counted: bool) -> Iterator[pa.RecordBatch]:
    """(src, dst) of a spanning forest of each group, or the groups' ``Selection``; groups follow one another over the batches."""
    names = ("band", "key", "low", "high", "block", "fp")
    kept: dict[str, np.ndarray] = {c: np.array([], np.int64) for c in names}

    def forest(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        a, b, selection = _within_groups(rows, bits, pivots)
        if counted:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in selection], list(Selection._fields))
        label = spanning_labels(len(rows["fp"]), a, b)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rows["fp"][linked]), pa.array(rows["fp"][label[linked]])], ["src", "dst"])

    for batch in batches:
        kept = {c: np.concatenate([kept[c], batch.column(i).to_numpy().astype(np.int64)]) for i, c in enumerate(names)}
        if not len(kept["fp"]):
            continue
        last = np.all([kept[c] == kept[c][-1] for c in names[:4]], axis=0)
        until = len(last) - np.argmin(last[::-1]) if not last.all() else 0  # where the last group begins
        if until:
            yield forest({c: v[:until] for c, v in kept.items()})
            kept = {c: v[until:] for c, v in kept.items()}
    if len(kept["fp"]):
        yield forest(kept)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, digest, fp)``: a row per document, its text's XXH64 and its SimHash as a signed long."""
    plain = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), T.StructField("digest", T.LongType()), T.StructField("fp", T.LongType())])
    return plain.mapInArrow(partial(_fingerprints, width=width), schema)


def _dealt(prints: DataFrame, bits: int, bands: int, block: int) -> DataFrame:
    """Fingerprints of ``prints(fp)`` by bucket and pair of blocks, those of one group one after another."""
    widths = [64 // bands + (i < 64 % bands) for i in range(bands)]
    masks = [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]
    keys = [sum(chosen) for chosen in combinations(masks, bands - bits)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in keys]
    rows = prints.select("fp").distinct().select(
        "fp", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)))).alias("at")
    ).select("fp", "at.band", "at.key")
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpointed(shared.withColumn("blocks", F.ceil(F.col("n") / block)))  # AQE splits no join with an aggregate in it
    dealt = (
        rows.join(shared, ["band", "key"])
        .withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp")
    )
    group = ("band", "key", "low", "high")
    return dealt.repartition(*group).sortWithinPartitions(*group)


def fingerprint_groups(prints: DataFrame, bits: int = 3, bands: int = 5, block: int = 1024) -> DataFrame:
    """``(fp, root)`` for each fingerprint of ``prints(fp)`` that links with another one.

    Distances of unrelated fingerprints to a pivot lie so close together that cells of them are no
    key to shuffle by. Fingerprints are therefore dealt into buckets that share all bits of
    ``bands - bits`` of ``bands`` bands, as every pair within ``bits`` does (C(5,3) = 10 keys of 25 or
    26 bits). In a bucket the pivot tables select: members are sorted by their distance to the
    first pivot, pairs are listed only within ``bits`` of each other there, the largest difference
    over all pivots discards, and survivors are verified. Buckets over ``block`` fingerprints are cut
    into blocks and each pair of blocks is a group of its own; groups return spanning forests,
    never their pairs. An empty table gives an empty result; no fingerprint is null.
    """
    links = _dealt(prints, bits, bands, block).mapInArrow(partial(_links, bits=bits, pivots=PIVOTS, counted=False), "src long, dst long")
    return components(links).select(F.col("id").alias("fp"), F.col("component").alias("root"))


def selection(prints: DataFrame, bits: int = 3, bands: int = 5, block: int = 1024) -> DataFrame:
    """One row with what the pivots do: sums of ``Selection`` over all groups (pairs in several buckets count in each)."""
    counts = _dealt(prints, bits, bands, block).mapInArrow(partial(_links, bits=bits, pivots=PIVOTS, counted=True), ", ".join(f"{c} long" for c in Selection._fields))
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in Selection._fields))


def near_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """``(<id_col>, fingerprint, component_id, digest, rep_id, rep_digest)``, a row per document.

    ``component_id`` is the smallest id reachable over fingerprints that differ in ``bits`` bits at
    most. The representative of a component, (rep_id, rep_digest), is its document with the
    smallest id, null ids last, and of several with that id the one with the smallest text digest.

    Texts are read whole. Null texts and texts without words have fingerprint zero, which links
    like any other. Repeated rows and exact copies share a fingerprint and are compared once. Null
    ids are never a component's name if it has another. An empty table gives an empty result;
    extra columns are left out.
    """
    prints = checkpointed(fingerprints(documents, id_col, text_col, width))
    roots = fingerprint_groups(prints, bits)
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("rep")
    distinct = checkpointed(prints.groupBy("fp").agg(rep).join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep"))
    named = checkpointed(distinct.groupBy("root").agg(F.min("rep").alias("rep")))
    named = distinct.select("fp", "root").join(named, "root").select("fp", F.col("rep.id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"))
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep_id").alias("component_id"), "digest", "rep_id", "rep_digest"
    )


def keep_one_text(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """The columns of ``documents``, with one document of each component: its representative.

    Of rows with the representative's id and text one stays. Extra columns are kept.
    """
    found = near_texts(documents, id_col, text_col, width, bits)
    reps = found.select(F.xxhash64("rep_id").alias("__id"), F.col("rep_digest").alias("__digest")).distinct()
    own = documents.select(whole_row(documents), F.xxhash64(id_col).alias("__id"), F.xxhash64(text_col).alias("__digest"))
    kept = own.join(reps, ["__id", "__digest"], "left_semi")  # the same two keys twice, so that texts move once
    return kept.dropDuplicates(["__id", "__digest"]).select(*own_columns(documents.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with fingerprint and component; odd rows as in ``near_texts``."""
    return near_texts(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict = {}
