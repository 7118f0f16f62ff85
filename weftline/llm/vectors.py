"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import checkpointed, read_table, sized
from weftline.llm.components import components, spanning_labels


def _keys(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Adds a digest of the vector; null for one that can link with nothing."""
    for batch in batches:
        nodes, vectors = [], []
        for value in batch.column(1):
            x = None
            if value.is_valid and len(value.values) and not value.values.null_count:
                x = value.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                x = x if np.isfinite(x).all() and np.any(x) else None
            nodes.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest())
            vectors.append(None if x is None else x.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.string()), pa.array(vectors, pa.binary())], ["id", "node", "vec"]
        )


def _unit(vectors: list[bytes] | pa.Array, kind: str) -> np.ndarray:
    joined = b"".join(vectors) if isinstance(vectors, list) else pa.concat_arrays([vectors]).buffers()[2]
    x = np.frombuffer(joined, kind).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of ``k`` cells of the unit vectors ``x``, from the first ``k`` of them on."""
    centroids = x[:k].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(part @ centroids.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


class Cells:
    """Cells of one vector length: unit centroids, and how far from a boundary a vector is a guest beyond it.

    One of two linked vectors on different sides of a boundary lies within tan(angle/2) * |d| of
    it, d being their unit difference along its normal; sin(angle/2) holds for any d. That d is taken
    as spread like the sample about its centroids or evenly, whichever is wider along that normal,
    and ``tail`` of its standard deviations are allowed for.
    """

    def __init__(self, x: np.ndarray, k: int, threshold: float, tail: float):
        angle = math.acos(threshold)
        self.most, self.per_deviation = math.sin(angle / 2) + 1e-9, tail * math.tan(angle / 2)
        self.centroids = spherical_kmeans(x, k)
        home = np.concatenate([np.argmax(part @ self.centroids.T, axis=1) for part in np.array_split(x, max(1, len(x) // 1024))])
        rest = x - self.centroids[home]
        spread = rest.T @ rest
        total = np.trace(spread)
        self.spread = spread / total if total > 1e-9 else np.eye(x.shape[1]) / x.shape[1]
        self.turned = self.centroids @ self.spread
        self.own = np.einsum("ij,ij->i", self.turned, self.centroids)
        self.unit = (self.centroids**2).sum(axis=1)

    def of(self, x: np.ndarray) -> list[list[int]]:
        """For each unit vector its home cell, then those of which it is a guest."""
        out = []
        rows = max(16, (1 << 22) // len(self.centroids))
        for part in (x[i : i + rows] for i in range(0, len(x), rows)):
            near = part @ self.centroids.T
            home = np.argmax(near, axis=1)
            apart = np.maximum(self.unit[home][:, None] + self.unit - 2 * (self.centroids[home] @ self.centroids.T), 1e-12)
            along = (self.own[home][:, None] + self.own - 2 * (self.turned[home] @ self.centroids.T)) / apart
            margin = np.minimum(self.most, self.per_deviation * np.sqrt(np.maximum(along, 1 / x.shape[1])))
            beside = near[np.arange(len(part)), home][:, None] - near <= margin * np.sqrt(apart)
            beside[np.arange(len(part)), home] = False
            out += [[int(h), *map(int, np.flatnonzero(row))] for h, row in zip(home, beside, strict=True)]
        return out


def _assign(batches: Iterator[pa.RecordBatch], kind: str, cells: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    """Adds each vector's length and its cells, home first; lengths without ``cells`` are one cell."""
    for whole in batches:
        for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
            raw = batch.column(2).to_pylist()
            size = np.array([len(v) for v in raw], np.int64) // np.dtype(kind).itemsize
            found: list[list[int]] = [[0]] * len(raw)
            for dim in set(size.tolist()) & set(cells):
                own = np.flatnonzero(size == dim)
                for i, some in zip(own, cells[dim].of(_unit([raw[i] for i in own], kind)), strict=True):
                    found[i] = some
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size.astype(np.int32)), pa.array(found, pa.list_(pa.int32()))], ["node", "weight", "vec", "dim", "cells"])


def _near(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows of ``x``) of the two sides at ``threshold`` or above: products in single precision pick, double ones decide."""
    small = x.astype(np.float32)
    a, b = np.nonzero(small[left] @ small[right].T >= threshold - 4e-7 * (x.shape[1] + 4))
    a, b = left[a], right[b]
    sure = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 8192]], x[b[i : i + 8192]]) >= threshold for i in range(0, len(a), 8192)] or [np.array([], bool)])
    return a[sure], b[sure]


def _compare(key: tuple, table: pa.Table, kind: str, threshold: float) -> pa.Table:
    """Links within one block of a cell, or between two; (node, weight of what it links, parent)."""
    _, cell, between, low, high = (k.as_py() for k in key)
    home, block = table["home"].to_numpy(), table["block"].to_numpy()
    if between:
        left, right = np.flatnonzero(home == cell), np.flatnonzero(home != cell)
    else:
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    empty = pa.table({"node": pa.array([], pa.string()), "links": pa.array([], pa.int64()), "parent": pa.array([], pa.string())})
    if not len(left) or not len(right):
        return empty
    x = _unit(table["vec"].combine_chunks(), kind)
    a, b = _near(x, left, right, threshold)
    if not between and low == high:
        a, b = a[a < b], b[a < b]
    if between and len(a):  # of two cells that both hold the pair, only the one with the smaller number counts it
        guests = table["guests"].combine_chunks()
        sizes = guests.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.repeat(np.arange(len(x)), sizes) << 32 | guests.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        once = ~((home[b] < cell) & np.isin(a << 32 | home[b], held))
        a, b = a[once], b[once]
    if not len(a):
        return empty
    weight = table["weight"].to_numpy()
    links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
    label = spanning_labels(len(x), a, b)
    linked = np.flatnonzero(links)
    node = table["node"].combine_chunks()
    return pa.table({"node": node.take(pa.array(linked)), "links": pa.array(links[linked].astype(np.int64)), "parent": node.take(pa.array(label[linked]))})


def fit_cells(classes: DataFrame, kind: str, threshold: float, tail: float, block: int, per_cell: int, least_sample: int, max_cells: int, max_lengths: int) -> dict[int, Cells]:
    """Cells for each of the commonest ``max_lengths`` lengths that has over ``block`` vectors."""
    width = np.dtype(kind).itemsize
    sizes = classes.groupBy(F.octet_length("vec").alias("bytes")).count().where(F.col("count") > block).orderBy(F.desc("count"), "bytes").limit(max_lengths).collect()
    wanted = {r["bytes"] // width: min(max_cells, round(math.sqrt(r["count"]) / 2)) for r in sizes}
    if not wanted:
        return {}
    drawn = F.lit(False)
    for r in sizes:
        share = max(least_sample, per_cell * wanted[r["bytes"] // width]) / r["count"]
        drawn = drawn | (F.octet_length("vec") == r["bytes"]) & (F.lit(share >= 1) | (F.col("node") < format(min(int(share * 2**32), 2**32 - 1), "08x")))
    sample = classes.where(drawn).select("node", "vec").toArrow().sort_by("node")["vec"].to_pylist()
    own = {dim: [v for v in sample if len(v) == dim * width] for dim in wanted}
    return {dim: Cells(_unit(own[dim], kind), min(k, len(own[dim])), threshold, tail) for dim, k in wanted.items() if own[dim]}


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    max_cells: int = 65536,
    sample: int = 16384,
    per_cell: int = 8,
    block: int = 512,
    guest_block: int = 8192,
    tail: float = 4.5,
    max_lengths: int = 64,
) -> DataFrame:
    """``(<id_col>, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors with the same components are one class. The distinct ones go to the cells of a
    spherical k-means: sqrt(n)/2 cells for each vector length, ``max_cells`` at most, fitted on
    ``per_cell`` vectors a cell and ``sample`` at least (in expectation). Every vector is indexed. A
    vector also goes, as a guest, to each cell whose boundary is near (``Cells``). With an infinite
    ``tail`` no pair can be lost, whatever the data, at several times as many guests. Lengths
    beyond the commonest ``max_lengths``, and those with no more than ``block`` vectors, are one cell each.

    Cells are cut into blocks of about ``block`` vectors, their guests into ``guest_block``, and each
    pair of blocks is one small group, so that a cell that holds a third of all rows is spread; a
    group returns counts and a spanning forest, never its pairs.

    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing. Vectors of different lengths do not link. A null id is never a component's name if
    another id is there. Repeated ids each get their row; repeated rows link with each other.
    An empty table gives an empty result; extra columns are left out.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(T.ArrayType(T.FloatType() if kind == "<f4" else T.DoubleType())).alias("vec"))
    id_type = plain.schema["id"].dataType
    keyed = plain.mapInArrow(partial(_keys, kind=kind), T.StructType([T.StructField("id", id_type), T.StructField("node", T.StringType()), T.StructField("vec", T.BinaryType())]))
    keyed = checkpointed(keyed)
    classes = keyed.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min("vec").alias("vec"), F.min("id").alias("first_id"))
    classes = checkpointed(classes)

    cells = fit_cells(classes, kind, threshold, tail, block, per_cell, sample, max_cells, max_lengths)
    assigned = classes.select("node", "weight", "vec").mapInArrow(partial(_assign, kind=kind, cells=cells), "node string, weight long, vec binary, dim int, cells array<int>")
    assigned = checkpointed(assigned)
    blocks = assigned.select("dim", F.posexplode("cells").alias("nth", "cell")).groupBy("dim", "cell").agg(
        F.ceil(F.sum((F.col("nth") == 0).cast("int")) / block).alias("homes"), F.ceil(F.sum((F.col("nth") > 0).cast("int")) / guest_block).alias("guest_blocks")
    )
    blocks = sized(checkpointed(blocks.where("homes > 0")), 1_000_000)  # 24 bytes a cell, of which there are at most max_cells for each fitted length
    placed = assigned.select("dim", "node", "weight", "vec", "cells", F.posexplode("cells").alias("nth", "cell")).join(blocks, ["dim", "cell"])
    at_home = F.col("nth") == 0
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.when(at_home, F.col("homes")).otherwise(F.col("guest_blocks")))).withColumn(
        "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1 + F.when(at_home, F.col("guest_blocks")).otherwise(0)))
    )
    across = ~at_home | (F.col("t") >= F.col("homes"))
    dealt = dealt.select(
        "dim", "cell", across.alias("between"),
        F.when(~at_home, F.col("t")).when(across, F.col("block")).otherwise(F.least("block", "t")).alias("low"),
        F.when(~at_home, F.col("block")).when(across, F.col("t") - F.col("homes")).otherwise(F.greatest("block", "t")).alias("high"),
        F.col("cells")[0].alias("home"), F.when(at_home & across, F.slice("cells", F.lit(2), F.size("cells"))).alias("guests"), "block", "node", "weight", "vec",
    )
    found = dealt.groupBy("dim", "cell", "between", "low", "high").applyInArrow(lambda key, table: _compare(key, table, kind, threshold), "node string, links long, parent string")
    found = checkpointed(found)

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("src"), F.col("parent").alias("dst"))).withColumnRenamed("id", "node")
    named = classes.drop("vec").join(linked, "node", "left").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = checkpointed(named)
    first = checkpointed(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = named.join(first, "component").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return keyed.drop("vec").join(named, "node", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("id") == F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``; odd vectors as in ``near_vectors``."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_near_vectors": op1_near_vectors}
SQL = {
    "op1_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9),
 r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
 n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
}
