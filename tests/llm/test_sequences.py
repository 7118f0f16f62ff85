"""Mixing and packing against brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import mixing, packing
from weftline.llm.common import read_table

ODD = ["", " ", "\n\n a  b\t\tc ", "don't they'll I'M x's", "ünïcode ß 漢字 😀 x² ½ Ⅷ", "<|endoftext|> in <|endoftext|>", "   blanks\u0085", "a_b __ -- ~!@#$%^&*()_+", "12 3٤ 1234567", "кириллица ελληνικά עברית عربي", "é combining", "\x00\x01\x1f control", "x" * 5000, " " * 3000 + "y"]


def test_encoder_gives_the_tokenizers_ids(sf, spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder("byte_bpe_50k")
    texts = ODD + [r.text for r in read_table(spark, sf, "documents").collect()]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    plain = _plain()
    assert np.frombuffer(packing.encoder("byte_bpe_50k")(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def _plain(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return kept[0]


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_takes_the_tightest_window(lengths):
    windows, offsets = packing.best_fit_decreasing(lengths, 50)
    rooms, expected = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits) if fits else 50
        if fits:
            rooms.remove(room)
        expected.append((i, 50 - room))
        rooms.append(room - lengths[i])
    assert [(i, offsets[i]) for i, _ in expected] == expected
    used = defaultdict(list)
    for w, o, n in zip(windows, offsets, lengths, strict=True):
        used[w].append((o, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 50


def check_pieces(texts, rows):
    """Every id lies in one piece, sequences are gapless and at most 2048 long; returns the padding."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(of) == set(texts)
    for i, own in of.items():
        ids = [*_plain().encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return 1 - sum(r.length for r in rows) / (2048 * len(sequences))


def test_packing(spark, sf):
    rows = packing.op4_packing(spark, sf).collect()
    assert check_pieces({r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}, rows) < 0.02


def test_odd_packing(spark, odd_documents, no_documents):
    once = odd_documents.where("doc_id in (1, 2, 3, 6, 7, 8)")
    check_pieces({r.doc_id: r.text for r in once.collect()}, packing.packed_digests(once).collect())
    assert packing.packed_digests(odd_documents).where("start = 0").count() == odd_documents.count()
    assert packing.packed_digests(no_documents).count() == 0
    ids = packing.cut_pieces(once, capacity=100).where("doc_id = 6").orderBy("start").collect()
    assert np.frombuffer(b"".join(r.ids for r in ids), "<u4").tolist() == [*_plain().encode(once.where("doc_id = 6").first().text).ids, 1]


def test_groups_stay_small(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0L AS start", "1 + id % 700 AS length", "1 + id % 700 AS doc_tokens", "'x' AS ids", "'y' AS sequence_id")
    found = packing.pack_pieces(pieces, per_group=500)
    sequences = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert found.count() == 5000 and sequences.where("n <> end OR n > 2048").count() == 0
    assert found.select((F.col("sequence_id") / 2**32).cast("int").alias("g")).distinct().count() == 10


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5, -7, 1 << 62):
            assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 1).tolist() != mixing.permuted(np.arange(1000), 1000, 2).tolist()


def water_fill(sizes, weights, total, most):
    """Targets that share ``total`` by weight; none above ``most`` times its size, the excess shared anew."""
    limits = most * sizes
    targets, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = float(total)
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share > limits)
        if not over.any():
            targets[free] = share[free]
            break
        targets[over] = limits[over]
        left -= float(limits[over].sum())
        free &= ~over
    return targets


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    table = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(table).collect()}
    expected = water_fill(np.array(sizes, float), np.array([mixing.WEIGHTS[i % 3] for i in range(len(sizes))], float), 1.5 * sum(sizes), 2.0)
    assert np.allclose([found[n] for n in names], expected)
    assert abs(sum(found.values()) - 1.5 * sum(sizes)) < 1e-6


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixing(spark, sf):
    docs = {r.doc_id: r for r in read_table(spark, sf, "documents").collect()}
    found = mixing.op9_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    taken, sizes, targets = defaultdict(int), defaultdict(int), {}
    for r in found:
        source = docs[r.doc_id].source
        assert r.size == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        sizes[source] += r.size
        targets[source] = r.target, r.source_size
    assert all(targets[s][1] == sizes[s] and abs(taken[s] - targets[s][0]) <= max(0.02 * targets[s][0], 64) for s in sizes)
    assert sorted(map(tuple, mixing.op9_mixing(spark, sf).collect())) == sorted(map(tuple, found))


def test_shards_are_multinomial(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', 640) AS text", "concat('s', id % 4) AS source", "0 AS n_chars")
    _, taken = mixing.mix(docs, per_shard=300)
    slots = taken.groupBy("shard", "slot", "key").count().count()
    by_shard = {r.shard: r.n for r in taken.groupBy("shard").agg(F.sum("words").alias("n")).collect()}
    assert slots > 0 and len(by_shard) == 20 and all(300 * 64 * 0.7 < n < 300 * 64 * 1.3 for n in by_shard.values())
    assert taken.groupBy("key", "digest", "copy", "epoch", "start").count().where("count > 1").count() == 0


def test_shard_counts_are_seeded_draws():
    slots = np.array([700, 0, 250, 50], np.int64)
    drawn = list(mixing.shard_counts(slots, 64, 5, 0, 16))
    assert [s for s, _, _ in drawn] == list(range(16)) and all(c.sum() == (64 if s < 15 else 1000 - 15 * 64) for s, c, _ in drawn)
    assert np.array_equal(sum(c for _, c, _ in drawn), slots)
    before = np.zeros(4, np.int64)
    for _, c, start in drawn:
        assert np.array_equal(start, before)
        before = before + c
    for low in (0, 5, 11):  # any task comes to the same counts
        assert all(x[0] == y[0] and np.array_equal(x[1], y[1]) and np.array_equal(x[2], y[2]) for x, y in zip(mixing.shard_counts(slots, 64, 5, low, low + 5), drawn[low : low + 5], strict=True))
    # over many seeds a shard's counts spread as a draw of 64 without return does
    first = np.array([next(iter(mixing.shard_counts(slots, 64, seed, 3, 4)))[1] for seed in range(2000)])
    p = slots / slots.sum()
    assert np.allclose(first.mean(axis=0), 64 * p, atol=0.4) and np.allclose(first.var(axis=0), 64 * p * (1 - p) * (1000 - 64) / 999, rtol=0.15, atol=0.01)


def test_large_splits_by_the_normal_limit(monkeypatch):
    slots = np.array([70_000, 0, 25_000, 5_000], np.int64)
    exact = np.array([mixing._drawn_half(slots, 50_000, np.random.default_rng(i)) for i in range(800)])
    monkeypatch.setattr(mixing, "_EXACT", 0)
    near = np.array([mixing._drawn_half(slots, 50_000, np.random.default_rng(i)) for i in range(800)])
    assert (near.sum(axis=1) == 50_000).all() and (near <= slots).all() and (near >= 0).all()
    assert np.allclose(near.mean(axis=0), exact.mean(axis=0), rtol=0.005) and np.allclose(near.var(axis=0), exact.var(axis=0), rtol=0.25)
    small = [mixing._drawn_half(np.array([3, 1, 0, 2]), 5, np.random.default_rng(i)) for i in range(50)]
    assert all(s.sum() == 5 and (s <= [3, 1, 0, 2]).all() for s in small)


def test_slots_have_the_shards_and_sources_counts(spark):
    rows = [(11, 40, 60), (-7, 25, 25), (5, 30, 7), (9, 3, 0)]
    sources = spark.createDataFrame(rows, "source_key long, blocks long, slots long")
    for most_sources in (10, 2):  # counts drawn by shard, and shards drawn by slot
        found = mixing.slot_table(sources, 16, 3, most_sources).collect()
        assert len(found) == len({(r.source_key, r.slot) for r in found}) == 92
        for key, blocks, slots in rows:
            own = sorted((r.slot, r.epoch, r.block) for r in found if r.source_key == key)
            assert [s for s, _, _ in own] == list(range(slots)) and len({(e, b) for _, e, b in own}) == slots and all(0 <= b < blocks for _, _, b in own)
    by_shard = defaultdict(int)
    for r in mixing.slot_table(sources, 16, 3).collect():
        by_shard[r.shard] += 1
    assert dict(by_shard) == {**dict.fromkeys(range(5), 16), 5: 12}
    assert mixing.slot_table(sources.where("false"), 16, 3).count() == 0


def test_very_many_copies(spark):
    docs = spark.range(40_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "if(id < 39000, 'one two three', concat('w', id)) AS text", "'s' AS source", "0L AS n_chars")
    found = mixing.taken_words(docs)
    assert found.count() == 40_000 and found.where("taken > 2 * size").count() == 0
    total = found.agg(F.sum("taken"), F.first("target")).first()
    assert abs(total[0] - total[1]) < 0.02 * total[1]
    assert sum(len(words(r.text)) for r in mixing.mixed_documents(docs).collect()) == total[0]


def test_mixed_texts_are_what_was_taken(spark, sf):
    docs = read_table(spark, sf, "documents")
    taken = {r.doc_id: r.taken for r in mixing.op9_mixing(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    mixed = defaultdict(list)
    for r in mixing.mixed_documents(docs).collect():
        mixed[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text) and all(part in texts[r.doc_id] for part in (r.text.split("\n") if r.text != texts[r.doc_id] else [r.text]))
    assert {i: sum(len(words(t)) for t in mixed[i]) for i in taken} == taken


def test_odd_mixing(spark, odd_documents, no_documents):
    found = mixing.taken_words(odd_documents)
    assert found.count() == odd_documents.count() and mixing.taken_words(no_documents).count() == 0
    assert found.where("taken > 2 * size OR (size = 0 AND taken > 0)").count() == 0
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns and mixing.mixed_documents(no_documents).count() == 0
    total = sum(len(words(r.text)) for r in mixed.collect())
    assert total == found.agg(F.sum("taken")).first()[0]


def test_pieces_that_are_alike_are_spread(spark):
    docs = spark.range(2000).selectExpr("CAST(null AS LONG) AS doc_id", "CAST(null AS STRING) AS text")
    found = packing.pack_pieces(packing.cut_pieces(docs), per_group=100)
    sizes = [r["count"] for r in found.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200
    assert found.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
