"""Near-duplicate vectors and texts, against all pairs."""

import math
import re

import numpy as np
import xxhash

from weftline.llm.components import components, spanning_labels
from weftline.llm.simhash import fingerprint, fingerprint_groups, keep_one_text, near_texts, op3_simhash
from weftline.llm.vectors import near_vectors


def brute_components(ids, linked):
    a, b = np.nonzero(linked)
    label = spanning_labels(len(ids), a, b)
    return {i: min(ids[j] for j in np.flatnonzero(label == label[k])) for k, i in enumerate(ids)}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5), (None, 3), (7, None)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    pairs = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    label = spanning_labels(len(nodes), np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs]))
    assert found == {x: nodes[label[at[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors_table(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int")


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0, 0.2, 0.35, 0.5)] + [np.repeat(base[:1], 25, axis=0)]).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    table = vectors_table(spark, [(int(i) + 10, v.tolist()) for i, v in enumerate(x)])
    for block in (512, 8):  # cells in one block and in many
        found = {r.vec_id: r for r in near_vectors(table, block=block, tail=math.inf).collect()}
        assert [found[i + 10].n_links for i in range(len(x))] == linked.sum(axis=1).tolist()
        assert {i: r.component_id for i, r in found.items()} == brute_components([i + 10 for i in range(len(x))], linked)
        assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_recall_with_the_default_margin(spark, sf):
    from weftline.llm.common import read_table

    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x = np.concatenate([base, 0.905 * base + math.sqrt(1 - 0.905**2) * away])
    found = near_vectors(vectors_table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).agg({"n_links": "sum"}).first()[0]
    assert found >= 0.99 * 800
    assert near_vectors(read_table(spark, sf, "embeddings")).count() == read_table(spark, sf, "embeddings").count()


def test_no_link_is_lost_in_low_rank_data(spark):
    """The production setting on vectors that differ in 4 of 64 dimensions only."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 64))).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    found = {r.vec_id: r.n_links for r in near_vectors(vectors_table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert [found[i] for i in range(len(x))] == linked.sum(axis=1).tolist()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [-0.0, 1.0])]
    table = vectors_table(spark, rows).selectExpr("*", "1 AS node", "2 AS links", "3 AS component_id", "4 AS dim")
    found = sorted(map(tuple, near_vectors(table).collect()), key=repr)
    assert found == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 1, 10, False), (10, 1, 10, True)], key=repr)
    assert near_vectors(table.where("false")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_all_pairs(spark, sf):
    from weftline.llm.common import read_table

    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    ids = sorted(texts)
    prints = np.array([brute_fingerprint(texts[i]) for i in ids], np.uint64)
    expected = brute_components(ids, np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    found = {r.doc_id: r for r in op3_simhash(spark, sf).collect()}
    assert {i: r.component_id for i, r in found.items()} == expected
    assert [found[i].fingerprint for i in ids] == [format(int(p), "016x") for p in prints]


def test_links_of_many_close_fingerprints(spark):
    """Groups over one block, chains, and pairs at exactly 3 and 4 bits."""
    rng = np.random.default_rng(5)
    near = {0} | {int(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3) for _ in range(150)}
    far = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    chain = [sum(1 << b for b in range(3 * i)) | 1 << 63 for i in range(20)]
    apart = [0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0F ^ 0b1111, 0xF0F0F0F0F0F0F0F0, 0xF0F0F0F0F0F0F0F0 ^ 1 << 63 ^ 1 << 31 ^ 1]
    values = np.array(sorted(near | set(far) | set(chain) | set(apart)), np.uint64)
    linked = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    np.fill_diagonal(linked, False)
    signed = values.view(np.int64)
    expected = brute_components(signed.tolist(), linked)
    table = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    for block in (1024, 40):
        found = {r.fp: r.root for r in fingerprint_groups(table, block=block).collect()}
        assert {v: found.get(v, v) for v in signed.tolist()} == expected


def test_odd_texts(spark, odd_documents, no_documents):
    found = near_texts(odd_documents)
    assert found.count() == odd_documents.count()
    empty = {r.doc_id: r for r in found.where("fingerprint = '0000000000000000'").collect()}
    assert set(empty) == {1, 2, 3, None} and all(r.component_id == 1 for r in empty.values())
    kept = keep_one_text(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r["__row"], r.fp) for r in kept.collect()) == [*((False, i, "row", "fp") for i in (1, 4, 4, 6, 7, 8, 9)), (True, 0, "row", "fp")]
    assert near_texts(no_documents).count() == 0 and keep_one_text(no_documents).count() == 0


def test_long_text_is_read_whole():
    text = " ".join(f"w{i}" for i in range(200_000))
    assert fingerprint(text.encode()) == fingerprint(text.encode()) != fingerprint(text[: len(text) // 2].encode())


def test_pivots_select_what_is_verified(spark, monkeypatch):
    """In a bucket of unrelated fingerprints nearly all pairs go before they are verified; without pivots all are verified."""
    from weftline.llm import simhash

    rng = np.random.default_rng(8)
    shared = (1 << 39) - 1 << 25  # three whole bands
    values = {int(x) & ~shared & (1 << 64) - 1 for x in rng.integers(0, 1 << 63, 900)}
    values |= {v ^ 5 for v in list(values)[:30]}
    signed = np.array(sorted(values), np.uint64).view(np.int64)
    prints = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    found = simhash.selection(prints, block=100).first()
    n = len(values)
    assert found.pairs >= n * (n - 1) // 2 and found.listed < 0.7 * found.pairs and found.left < 0.02 * found.pairs and found.links >= 30
    expected = {r.fp: r.root for r in fingerprint_groups(prints).collect()}
    monkeypatch.setattr(simhash, "PIVOTS", np.array([], np.uint64))
    without = simhash.selection(prints, block=2000).first()
    assert without.left == without.listed == without.pairs
    assert {r.fp: r.root for r in fingerprint_groups(prints).collect()} == expected  # they discard no link
    assert simhash.selection(prints.where("false")).first().pairs == 0
