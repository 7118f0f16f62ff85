import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import events as fn
from weftline.functions import hashes
from weftline.operators import append, blocks, lsm, ops, read, recover
from weftline.sources import records, storage
from weftline.streaming import streams

EVENT = "stream string, version int, sequence long, type string, data string, rec_size int"
FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def events(spark, *rows):
    return spark.createDataFrame([(s, v, i, t, d, 42 + len(t) + len(d)) for i, (s, v, t, d) in enumerate(rows)], EVENT)


def test_store_contract(spark):
    """First version 0; a read after the last version is too high; what was appended reads back."""
    none = events(spark)
    first = append.append_any(none, spark.createDataFrame([("stream-1", 0, "type-a", "data-1"), ("stream-1", 1, "type-a", "data-2")], "stream string, pos long, type string, data string"))
    assert [(r.version, r.data) for r in read.read_page(first, "stream-1").collect()] == [(0, "data-1"), (1, "data-2")]
    probes = spark.createDataFrame([("stream-1", 1), ("stream-1", 2), ("none", 0)], "stream string, version int")
    assert {(r.stream, r.version): r.status for r in read.read_status(first, probes).collect()} == {("stream-1", 1): 0, ("stream-1", 2): -22, ("none", 0): -11}
    assert read.version_of(first, probes.select("stream").distinct()).where("stream = 'none'").first().version == -1


def test_pages_follow_one_another(spark):
    all_events = events(spark, *(("s", v, "t", str(v)) for v in range(25)))
    seen, at = [], 0
    while page := read.read_page(all_events, "s", at, 10).collect():
        seen += [r.version for r in page]
        at = seen[-1] + 1
    assert seen == list(range(25))


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-1, 4)), max_size=20))
def test_conditional_appends(spark, wanted):
    incoming = spark.createDataFrame([(s, i, e) for i, (s, e) in enumerate(wanted)], "stream string, pos long, expected int")
    current = events(spark, ("a", 0, "t", "x"))
    version, expected = {"a": 0, "b": -1}, []
    for i, (s, e) in enumerate(wanted):
        ok = e in (-1, version[s] + 1)
        version[s] += ok
        expected.append((s, i, e, ok, version[s] if ok else None))
    assert sorted(map(tuple, append.append_expected(current, incoming).collect()), key=lambda r: r[1]) == expected


@FEW
@given(st.sets(st.integers(0, 30)), st.sets(st.integers(0, 30)))
def test_lookups(spark, keys, probes):
    a = spark.createDataFrame([("s", k) for k in keys], "stream string, version int")
    b = spark.createDataFrame([("s", p) for p in probes] + [("other", 3)], "stream string, version int")
    rule = {"equals": lambda p: p if p in keys else None, "floor": lambda p: max((k for k in keys if k <= p), default=None), "ceiling": lambda p: min((k for k in keys if k >= p), default=None), "lower": lambda p: max((k for k in keys if k < p), default=None), "higher": lambda p: min((k for k in keys if k > p), default=None)}
    for how, f in rule.items():
        found = {(r.stream, r.version): r.found for r in read.lookup(a, b, how).collect()}
        assert found == {**{("s", p): f(p) for p in probes}, ("other", 3): None}
    with pytest.raises(ValueError):
        read.lookup(a, b, "near")


@FEW
@given(st.lists(st.integers(1, 200), min_size=1, max_size=30), st.integers(60, 400))
def test_blocks_hold_all_events_within_the_budget(spark, sizes, budget):
    all_events = spark.createDataFrame([("s", i, i, "t", "d", n) for i, n in enumerate(sizes)], EVENT)
    packed = sorted(blocks.pack_blocks(all_events, budget).collect(), key=lambda b: b.start_version)
    assert sum(b.entries for b in packed) == len(sizes)
    assert all(b.bytes <= budget or b.entries == 1 for b in packed)
    assert all(x.bytes + sizes[y.start_version] > budget for x, y in zip(packed, packed[1:], strict=False))
    assert sorted(r.version for r in blocks.explode_blocks(blocks.block_bodies(all_events, budget)).collect()) == list(range(len(sizes)))


def test_compaction_is_idempotent_and_prefers_low_levels(spark):
    runs = spark.createDataFrame([("s", 0, "old", 1, 0), ("s", 0, "new", 0, 1), ("s", 0, "mid", 0, 0), ("s", 1, "only", 1, 0)], "stream string, version int, data string, level int, idx long")
    once = lsm.compact(runs)
    assert sorted(map(tuple, once.collect())) == [("s", 0, "new"), ("s", 1, "only")]
    again = lsm.compact(once.withColumn("level", F.lit(2)).withColumn("idx", F.lit(0).cast("long")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    assert [r.data for r in lsm.merge_runs(runs.withColumn("run", F.col("idx") - 10 * F.col("level"))).collect()][:3] == ["new", "mid", "old"]


def test_segments(spark):
    view = spark.createDataFrame([(0, 1), (0, 2), (1, 0)], "level int, idx long")
    assert [(r.level, r.idx) for r in lsm.segment_order(view).orderBy("place").collect()] == [(0, 2), (0, 1), (1, 0)]
    log = spark.createDataFrame([(1, "ADD", 0, 1), (2, "ADD", 0, 2), (3, "ADD", 1, 3), (4, "DELETE", 0, 1), (5, "DELETE", 0, 2)], "pos long, op string, level int, idx long")
    assert [tuple(r) for r in lsm.segment_state(log).collect()] == [(1, 3)]
    assert lsm.invalid_segment_ops(log).count() == 0
    empty = view.where("false")
    assert lsm.compaction_plan(empty).count() == 0 and lsm.next_idx(empty, spark.sql("SELECT 4 level")).first().next_idx == 0
    assert view.select(fn.segment_id_text().alias("t")).first().t == "0000000000-0000000000000000001"


def test_valid_prefix_stops_at_the_first_bad_record(spark):
    log = events(spark, *(("s", v, "t", "é" * v) for v in range(6))).withColumn("checksum", fn.checksum(fn.event_body()) + F.when(F.col("sequence") == 3, 1).otherwise(0))
    assert recover.valid_prefix(log, fn.is_valid(), "sequence").count() == 3
    assert recover.valid_events(log).count() == 5
    assert recover.to_replay(log).count() == 6 and recover.last_flush(log.where("false")).first().last_sequence == -1


def test_checksum_seed(spark):
    assert spark.sql("SELECT encode('abc', 'UTF-8') x").select(fn.checksum("x").alias("c")).first().c == 3139053765


def test_hash_vectors():
    assert hashes.murmur3_32(b"", 0) == 0 and hashes.murmur3_32(b"hello", 0) == 0x248BFA47 and hashes.murmur3_32(b"The quick brown fox jumps over the lazy dog", 0x9747B28C) == 0x2FA826CD
    assert hashes.crc32c(b"123456789") == 0xE3069283
    assert hashes.stream_key("naïve") != hashes.stream_key("naive")


def test_sequence_operators(spark):
    all_events = events(spark, *(("s", v, "t", "d") for v in range(5)))
    assert sorted(r.batch for r in ops.batching(all_events, 2, "stream", "version").collect()) == [0, 0, 1, 1, 2]
    assert ops.cycle(all_events, 3).count() == 15 and ops.cycle(all_events, 0).count() == 0
    assert [r.version for r in ops.gap_check(all_events.where("version <> 2")).collect()] == [3]
    assert sorted(r.version for r in ops.renumbered(all_events.where("version > 2")).collect()) == [0, 1]
    assert [r.sequence for r in append.stamped(all_events.withColumnRenamed("sequence", "pos"), 9).orderBy("sequence").collect()] == list(range(10, 15))


def test_record_files(spark, tmp_path):
    bodies = [b"a", b"", b"x" * 8192]
    data = b"".join(struct.pack(">i", len(b) + 4) + b for b in bodies)
    (tmp_path / "seg").write_bytes(data + struct.pack(">i", 100) + b"short")
    records.register(spark)
    found = spark.read.format("records").option("paths", str(tmp_path / "seg")).load().orderBy("offset").collect()
    assert [bytes(r.body) for r in found] == bodies


def test_runs_prune_by_statistics(spark, tmp_path):
    all_events = events(spark, *((f"s{i % 9}", i // 9, "t", "d") for i in range(90)))
    storage.write_run(all_events, f"{tmp_path}/run", level=4, partitions=3)
    page = read.read_page(storage.read_log(spark, f"{tmp_path}/run"), "s3", 4)
    assert [r.version for r in page.collect()] == list(range(4, 10))
    assert "PushedFilters: [IsNotNull(stream), IsNotNull(version), EqualTo(stream,s3), GreaterThanOrEqual(version,4)]" in page._jdf.queryExecution().toString()
    both = storage.read_runs(spark, [(f"{tmp_path}/run", 0, 1), (f"{tmp_path}/run", 1, 0)])
    assert lsm.precedence(both).where("level = 0").count() == 90
    storage.append_log(all_events, f"{tmp_path}/log", segment_rows=20)
    assert len(list((tmp_path / "log").glob("*.parquet"))) >= 5
    assert storage.read_log(spark, f"{tmp_path}/log").count() == 90 and storage.empty_events(spark).count() == 0
    storage.dump_text(all_events, f"{tmp_path}/dump")
    assert spark.read.text(f"{tmp_path}/dump").count() == 90


def test_streams(spark, tmp_path):
    all_events = events(spark, *((f"s{i % 3}", i // 3, "ab"[i % 2], "d") for i in range(30))).drop("rec_size")
    all_events.write.parquet(f"{tmp_path}/log")
    tail = streams.tail(spark, f"{tmp_path}/log", all_events.schema)
    seen = {}
    streams.dispatch(tail, {t: lambda batch, n, t=t: seen.update({t: seen.get(t, 0) + batch.count()}) for t in "ab"}, f"{tmp_path}/c1")
    assert seen == {"a": 15, "b": 15}
    streams.run_available(streams.versioned(tail.select("stream", "sequence")), f"{tmp_path}/out", f"{tmp_path}/c2")
    found = spark.read.parquet(f"{tmp_path}/out").groupBy("stream").agg(F.sort_array(F.collect_list("version")).alias("v")).collect()
    assert {r.stream: r.v for r in found} == {f"s{i}": list(range(10)) for i in range(3)}


def test_streamed_appends_and_versions_go_on_over_many_batches(spark, tmp_path):
    schema = "stream string, pos long, type string, data string, sequence long"
    for k in range(4):
        rows = [(f"s{i % 3}", 10 * k + i, "t", "d", 10 * k + i) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        tail = streams.tail(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        streams.append_batches(tail.select("stream", "pos", "type", "data"), f"{tmp_path}/log", f"{tmp_path}/c1")
        streams.run_available(streams.versioned(tail.select("stream", "sequence")), f"{tmp_path}/out", f"{tmp_path}/c2")
    for path, order in ((f"{tmp_path}/log", "pos"), (f"{tmp_path}/out", "sequence")):
        found = spark.read.parquet(path).orderBy("stream", order).groupBy("stream").agg(F.sort_array(F.collect_list(F.struct(order, "version"))).alias("v")).collect()
        assert {r.stream: [x.version for x in r.v] for r in found} == {"s0": list(range(16)), "s1": list(range(12)), "s2": list(range(12))}
    assert len(list((tmp_path / "log-versions").glob("batch=*"))) == 2
