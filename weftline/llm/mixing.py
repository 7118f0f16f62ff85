"""Mixing sources to target weights: fixed-length blocks, multinomial counts per shard, permuted indexes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import NOT_BREAK, checkpointed, numbered, own_columns, quoted, read_table, recounted, sized, whole_row

WEIGHTS = (5, 2, 1)
_WORD = re.compile(NOT_BREAK + "+")


def source_targets(sizes: DataFrame, weights=WEIGHTS, factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, size, ...)`` with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn, and share ``factor`` of all sizes;
    none gets above ``most`` times its own, the excess is shared anew until none is above. Each
    round is one sum over the sources; those found full stay so, and a round that finds none ends
    it. No sources give no rows; an empty source gets nothing.
    """
    placed = numbered(sizes, F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("__n"), F.lit(len(weights))) + 1).cast("int"))
    placed = checkpointed(placed.withColumn("weight", weight).drop("__n"))
    limit = most * F.col("size")
    total = factor * (placed.agg(F.sum("size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the level rises with each round, and so does the number of full ones
        over = F.lit(level) * F.col("weight") > limit if full >= 0 else F.lit(False)
        found = placed.agg(F.count_if(over).alias("full"), F.sum(F.when(over, limit)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if found["free"] is None or found["full"] == full:
            break
        full, level = found["full"], (total - (found["held"] or 0.0)) / found["free"]
    return placed.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit).cast("double")).drop("weight")


def _mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """``index`` under a pseudorandom permutation of 0..n-1: a Feistel network, walked until below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = _mix64((np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(key % (1 << 64)))
    x = index.astype(np.uint64)
    walk = np.ones(len(x), bool)
    while walk.any():
        left, right = x[walk] >> np.uint64(half), x[walk] & mask
        for k in keys:
            left, right = right, left ^ (_mix64(right ^ k) & mask)
        x[walk] = (left << np.uint64(half)) | right
        walk &= x >= n
    return x.astype(np.int64)


#: Slots beyond which a split is drawn by its normal limit; NumPy's exact draw ends at 10^9.
_EXACT = 500_000_000


def _drawn_half(slots: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` slots drawn without return belong to each source, of which there are ``slots``."""
    total = int(slots.sum())
    if total < _EXACT:
        return rng.multivariate_hypergeometric(slots, take, method="marginals")
    out, left, rest = np.zeros_like(slots), take, total
    for i in np.argsort(slots, kind="stable"):
        own = int(slots[i])
        if not own:
            continue
        mean = left * (own / rest)
        spread = math.sqrt(max(0.0, mean * (1 - own / rest) * ((rest - left) / max(rest - 1, 1))))
        out[i] = min(own, left, max(0, left - (rest - own), round(mean + spread * rng.standard_normal())))
        left, rest = left - int(out[i]), rest - own
    return out


def shard_counts(slots: np.ndarray, per_shard: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts, starts) of shards ``first`` to ``last`` - 1: slots of each source in it, and in all before it.

    Each shard's counts are a multinomial draw over the sources given that all shards together
    hold ``slots``. They are drawn by halves: the slots of a range of shards are dealt to its two
    halves by a draw seeded with that range, so that any task comes to the same counts with as
    many draws as the number of shards has bits. Every shard has ``per_shard`` slots, the last the rest.
    """
    total = int(slots.sum())
    shards = -(-total // per_shard)

    def within(low: int, high: int, own: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, own, before
            return
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, low, high]))
        half = _drawn_half(own, (middle - low) * per_shard, rng)
        yield from within(low, middle, half, before)
        yield from within(middle, high, own - half, before + half)

    yield from within(0, shards, slots, np.zeros_like(slots))


def _block_rows(key: int, blocks: int, shard: np.ndarray, slot: np.ndarray, seed: int) -> pa.RecordBatch:
    """The block of each of a source's slots: slot j holds perm(j mod blocks), another perm in each pass."""
    epoch = slot // blocks
    index = np.empty_like(slot)
    for e in np.unique(epoch):
        own = epoch == e
        index[own] = permuted(slot[own] % blocks, blocks, key ^ seed ^ (int(e) << 32))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), key)), *map(pa.array, (index, shard, slot, epoch))], ["source_key", "block", "shard", "slot", "epoch"])


_SLOTS = "source_key long, block long, shard long, slot long, epoch long"


def _drawn_slots(batches: Iterator[pa.RecordBatch], keys: np.ndarray, blocks: np.ndarray, slots: np.ndarray, per_shard: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The slots of runs of shards (first, last)."""
    for batch in batches:
        for low, high in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            drawn = list(shard_counts(slots, per_shard, seed, low, high))
            counts, starts = np.array([c for _, c, _ in drawn]), np.array([s for _, _, s in drawn])
            for i in np.flatnonzero(counts.sum(axis=0)):
                shard = np.repeat(np.array([s for s, _, _ in drawn], np.int64), counts[:, i])
                begin = int(starts[0, i])  # a source's slots go on from shard to shard
                yield _block_rows(int(keys[i]), int(blocks[i]), shard, np.arange(begin, begin + len(shard), dtype=np.int64), seed)


def _scattered_slots(batches: Iterator[pa.RecordBatch], shards: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The slots of runs (source_key, blocks, low, high) of single sources, each of which draws its own shard."""
    for batch in batches:
        for key, blocks, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            slot = np.arange(low, high, dtype=np.int64)
            with np.errstate(over="ignore"):
                drawn = _mix64(slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((key ^ seed) % (1 << 64)))
            yield _block_rows(key, blocks, (drawn % np.uint64(shards)).astype(np.int64), slot, seed)


def slot_table(sources: DataFrame, per_shard: int, seed: int, most_sources: int = 100_000) -> DataFrame:
    """``(source_key, block, shard, slot, epoch)`` of all slots of ``sources(source_key, blocks, slots)``.

    A task draws the counts of 16 shards at a time, for which it holds 24 bytes a source; with over
    ``most_sources`` of them, a checked number, no vector of sources is held and each slot draws its
    shard instead: sources still have their exact slots, but the shards' lengths are random too.
    """
    spark = sources.sparkSession
    own = sources.where("slots > 0").select("source_key", "blocks", "slots")
    count, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    shards = max(1, -(-total // per_shard))
    if count > most_sources:
        run = 1 << 14
        runs = own.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(run).cast("long"))))
        runs = runs.select("source_key", "blocks", "low", F.least(F.col("low") + run, "slots").alias("high")).repartition(min(20_000, -(-total // run)), "source_key", "low")
        return runs.mapInArrow(partial(_scattered_slots, shards=shards, seed=seed), _SLOTS)
    table = own.orderBy("source_key").toArrow()
    keys, blocks, slots = (table[c].to_numpy().astype(np.int64) for c in ("source_key", "blocks", "slots"))
    # as many partitions as runs, since these few numbers become all slots
    runs = spark.range(0, -(-total // per_shard), 16, numPartitions=max(1, min(20_000, -(-shards // 16)))).select(F.col("id").alias("first"), (F.col("id") + 16).alias("last"))
    return runs.mapInArrow(partial(_drawn_slots, keys=keys, blocks=blocks, slots=slots, per_shard=per_shard, seed=seed), _SLOTS)


#: What names a row: digests of its id and source and of its text, and a number among rows alike in these.
ROW = ("key", "digest", "copy")


def _named(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    return [F.xxhash64(quoted(id_col), quoted(source_col)).alias("key"), F.xxhash64(quoted(text_col)).alias("digest")]


def mix(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, factor: float = 1.5, most: float = 2.0,
    length: int = 64, per_shard: int = 4096, per_bucket: int = 256, seed: int = 42, most_sources: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, taken)``: every document with its size and its source's target, and what the mix takes.

    ``rows``: id, key, digest, copy (the last three name a row), size, source_size, target.
    ``taken``: the same names, and shard, slot, epoch, start and words: a part of that document in a
    block of ``length`` words that fills a slot of an output shard.

    Within a source, documents are dealt into buckets of about ``per_bucket`` by hash, and each bucket's words, in order
    of id, are cut into blocks; so a source with a third of all rows is many buckets, and only the
    buckets' block counts are summed up over a source, in two steps. A source has as many slots as
    come nearest to its target. Shards of ``per_shard`` slots draw how many of them each source has
    (``shard_counts``), and those are the source's next slots; slot j holds block perm(j mod n) of
    its n, with another permutation in each pass, so that no block is taken more than ``most``
    times, rounded up.

    Sizes count words of whole texts; a null text has none and is never taken. A null source is a
    source, the last by name. Ids may be null; rows alike in id, text and source are copies, each
    with a number. Extra columns are left out; an empty table gives empty results.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    plain = documents.select(
        F.col(quoted(id_col)).alias("id"), *_named(documents, id_col, text_col, source_col), F.xxhash64(quoted(source_col)).alias("source_key"), F.col(quoted(source_col)).alias("source"),
        F.regexp_count(text, F.lit(NOT_BREAK + "+")).cast("long").alias("size"),
    )
    # copies are counted before they move and then dealt in runs, so no task gets all of very many
    alike = checkpointed(plain.groupBy("key", "digest", "id", "source_key", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    run = 1 << 14
    several = alike.where("copies > 1").withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(run).cast("long")))).repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "digest", "from")
    several = several.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + run - 1, "copies")))).drop("from")
    plain = alike.where("copies = 1").withColumn("copy", F.lit(1).cast("long")).unionByName(several).drop("copies")
    buckets = plain.where("size > 0").groupBy("source_key").agg(F.ceil(F.count(F.lit(1)) / per_bucket).alias("buckets"))
    buckets = sized(checkpointed(buckets), 10_000)
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy(F.col("id").isNull(), "id", *ROW)
    dealt = plain.where("size > 0").join(buckets, "source_key").withColumn("bucket", F.pmod(F.xxhash64(*ROW), "buckets"))
    sums = checkpointed(dealt.groupBy("source_key", "bucket").agg(F.ceil(F.sum("size") / length).alias("blocks")).withColumn("part", F.floor(F.col("bucket") / 4096)))
    before = lambda by, order: F.sum("blocks").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    parts = sums.groupBy("source_key", "part").agg(F.sum("blocks").alias("blocks"))
    parts = checkpointed(parts.withColumn("first", F.coalesce(before(["source_key"], "part"), F.lit(0))))
    sums = sums.withColumn("within", F.coalesce(before(["source_key", "part"], "bucket"), F.lit(0))).join(sized(parts.select("source_key", "part", "first"), 100_000), ["source_key", "part"])
    sums = checkpointed(sums.select("source_key", "bucket", (F.col("first") + F.col("within")).alias("base")))
    counts = parts.groupBy("source_key").agg(F.sum("blocks").alias("blocks"))
    sources = source_targets(plain.groupBy("source_key", "source").agg(F.sum("size").alias("size")), weights, factor, most)
    sources = sources.join(counts, "source_key", "left")
    slots = F.least(F.round(F.col("target") / F.col("size") * F.col("blocks")), F.floor(most * F.col("blocks")).cast("double")).cast("long")
    sources = checkpointed(sources.withColumn("slots", F.when(F.col("blocks") > 0, slots).otherwise(0)))
    slots = slot_table(sources, per_shard, seed, most_sources)

    begin = F.coalesce(F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    cut = dealt.withColumn("begin", begin).join(sums, ["source_key", "bucket"])
    cut = cut.withColumn("nth", F.explode(F.sequence(F.floor(F.col("begin") / length), F.floor((F.col("begin") + F.col("size") - 1) / length))))
    start = F.greatest(F.col("nth") * length - F.col("begin"), F.lit(0))
    end = F.least((F.col("nth") + 1) * length - F.col("begin"), "size")
    pieces = cut.select(*ROW, "source_key", (F.col("base") + F.col("nth")).alias("block"), start.alias("start"), (end - start).alias("words"))
    # Spark takes the slots for as few as the runs that they come from; the hint keeps them from being broadcast
    taken = pieces.join(slots.hint("merge"), ["source_key", "block"]).select(*ROW, "shard", "slot", "epoch", "start", "words")
    rows = plain.join(sized(sources.select("source_key", F.col("size").alias("source_size"), "target"), 10_000), "source_key").select("id", *ROW, "size", "source_size", "target")
    return rows, taken


def taken_words(documents: DataFrame, **options) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it.

    Null texts have size and taken 0; null and repeated ids and rows each have their row; an empty
    table gives an empty result.
    """
    rows, taken = mix(documents, **options)
    sums = taken.groupBy(*ROW).agg(F.sum("words").alias("taken"))
    return rows.join(sums, [*ROW], "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut_texts(batches: Iterator[pa.RecordBatch], text_at: int, parts_at: int) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
        texts = []
        for text, parts in zip(batch.column(text_at).to_pylist(), batch.column(parts_at).to_pylist(), strict=True):
            at = [m.span() for m in _WORD.finditer(text)]
            merged: list[list[int]] = []
            for part in sorted(parts, key=lambda p: p["start"]):
                if merged and merged[-1][1] == part["start"]:
                    merged[-1][1] += part["words"]
                else:
                    merged.append([part["start"], part["start"] + part["words"]])
            texts.append(text if merged == [[0, len(at)]] else "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in merged))
        columns = [pa.array(texts, batch.schema.field(text_at).type) if i == text_at else batch.column(i) for i in range(parts_at)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:parts_at])


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The columns of ``documents``, a row for each pass of the mix over a document that takes words of it.

    The text is what that pass takes: the whole one, or the stretches of words in blocks that were
    taken, each as it stands and on lines of their own. Other columns are as in the document;
    ``n_chars``, if there, is counted anew. Of rows alike in id, source and text, which are one
    text that is taken for each of them, the other columns are those of one. Null and blank texts
    have no words and give no row; null ids and sources are like others; an empty table gives an
    empty result.
    """
    _, taken = mix(documents, id_col, text_col, source_col, **options)
    parts = checkpointed(taken.groupBy(*ROW, "epoch").agg(F.collect_list(F.struct("start", "words")).alias("parts"))).drop("copy", "epoch")
    own = documents.select(whole_row(documents), *_named(documents, id_col, text_col, source_col))
    joined = own.dropDuplicates(["key", "digest"]).join(parts, ["key", "digest"])  # the same keys twice, so that texts move once
    joined = joined.select(*(c.alias(f"c{i}") for i, c in enumerate(own_columns(documents.columns))), "parts")
    at = documents.columns.index(text_col)
    return recounted(joined.mapInArrow(partial(_cut_texts, text_at=at, parts_at=len(documents.columns)), documents.schema), text_col)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all ``documents``; odd rows as in ``mix``."""
    return taken_words(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_mixing": op9_mixing}
SQL: dict = {}
