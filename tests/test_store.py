import json
import struct
import threading
import time
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import codec, codecs, config, hashes
from weftline.operators import blocks, read
from weftline.sources import records, storage
from weftline.store import INCOMING, EventStore, StoreLocked, VersionMismatch


def incoming(spark, *rows):
    return spark.createDataFrame([(s, i, "t", d, e) for i, (s, d, e) in enumerate(rows)], INCOMING)


def test_empty_store(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    assert store.version("s") == -1 and store.status("s") == -11 and store.read("s").count() == 0 and store.read_json("s") == "[]"
    assert store.last_sequence() == -1 and store.flush() is None and store.compact() == [] and store.vacuum() == 0 and store.log().count() == 0


def test_appends_reads_flushes_and_compacts(spark, tmp_path):
    store = EventStore(spark, f"{tmp_path}/")
    assert store.append_event("a", "t", '{"x":1}') == 0 and store.append_event("a", "t", "plain", expected=1) == 1
    with pytest.raises(VersionMismatch):
        store.append_event("a", "t", "late", expected=1)
    assert store.status("a", 1) == 0 and store.status("a", 2) == -22
    found = json.loads(store.read_json("a"))
    assert all(abs(e.pop("timestamp") - time.time() * 1000) < 3_600_000 for e in found)  # in milliseconds
    assert found == [{"version": 0, "type": "t", "data": {"x": 1}}, {"version": 1, "type": "t", "data": "plain"}]
    assert store.flush() == (0, 0) and store.memtable().count() == 0
    decided = store.append(incoming(spark, ("a", "2", 2), ("a", "no", 2), ("b", "0", -1), ("a", "3", 3), ("b", "no", 5)))
    assert sorted((r.stream, r.pos, r.ok, r.version) for r in decided.collect()) == [("a", 0, True, 2), ("a", 1, False, None), ("a", 3, True, 3), ("b", 2, True, 0), ("b", 4, False, None)]
    before = store.events()
    assert store.flush() == (0, 1) and store.append_event("b", "t", "1") == 1 and store.flush() == (0, 2)
    assert store.compact() == [{"sources": [(0, 0), (0, 1)], "level": 1, "idx": 0}]
    assert sorted((r.level, r.idx) for r in store.segments().collect()) == [(0, 2), (1, 0)]
    assert sorted((r.stream, r.version) for r in before.where("stream = 'a' OR stream = 'b'").collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]  # its files are still there
    again = EventStore(spark, str(tmp_path))
    assert again.vacuum() == 2
    found = sorted((r.stream, r.version, r.data) for r in again.events().where("stream <> '_system'").collect())
    assert found == [("a", 0, '{"x":1}'), ("a", 1, "plain"), ("a", 2, "2"), ("a", 3, "3"), ("b", 0, "0"), ("b", 1, "1")]
    sequences = [r.sequence for r in again.log().collect()]
    assert sequences == list(range(9)) and again.invalid_events().count() == 0 and again.log(6).count() == 2
    assert sum(r.stream == "_system" for r in again.log().collect()) == 3


def test_crashes(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    store.append(incoming(spark, ("a", "0", -1), ("a", "1", -1)))
    storage.write_run(store.memtable(), f"{tmp_path}/runs/level=0/idx=0")  # a run that the segment log does not name
    assert sorted(r.version for r in store.events().collect()) == [0, 1]
    store._write_run(store._pending(), 0, upto=store.last_sequence())  # the flush marker is not written
    assert store.memtable().count() == 0 and sorted(r.version for r in store.events().collect()) == [0, 1]
    (tmp_path / "log" / "batch=2" / "_temporary").mkdir(parents=True)  # a batch that was not completed
    assert store.repair() == 1 and store.append_event("a", "t", "2") == 2 and store.flush() == (0, 1)
    assert sorted(r.version for r in store.events().where("stream = 'a'").collect()) == [0, 1, 2]


def test_two_writers(spark, tmp_path):
    one = EventStore(spark, str(tmp_path))
    one.append_event("a", "t", "0")
    late = EventStore(spark, str(tmp_path))
    late.last_sequence = lambda: -1  # what it saw before the other one wrote
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        late.append_event("b", "t", "0")
    assert one.log().count() == 1


def test_a_segment_log_that_contradicts_itself(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    store._log_segments([("ADD", 0, 0, 1), ("ADD", 0, 0, 1)])
    with pytest.raises(ValueError):
        store.segments()


def record(stream, version, sequence, millis, kind, data, spoil=0):
    body = struct.pack(">qiqqhi", stream, version, sequence, millis, len(kind), len(data)) + kind + data
    return struct.pack(">iI", len(body) + 8, zlib.crc32(bytes.fromhex("1B39B11B") + body) ^ spoil) + body


def test_binary_records(spark, tmp_path):
    rows = [(-5, -1, 1 << 40, 1_700_000_000_123, "é".encode(), b"\x00\xff"), (1 << 62, 7, 0, -1, b"", b""), (3, 1, 2, 4, b"t", b"x" * 70_000)]
    (tmp_path / "segment").write_bytes(b"".join(record(*r) for r in rows) + record(*rows[0], spoil=1) + b"\0\0\0\x30short")
    found = records.read_events(spark, str(tmp_path / "segment")).orderBy("offset").collect()
    assert [r.valid for r in found] == [True, True, True, False]
    assert [(r.stream_hash, r.version, r.sequence, r.timestamp, r.type.encode(), bytes(r.data)) for r in found[:3]] == rows
    table = spark.createDataFrame([(s, v, q, m, k.decode(), d) for s, v, q, m, k, d in rows], "stream_hash long, version int, sequence long, m long, type string, data binary").withColumn("ts", F.timestamp_millis("m"))
    assert sorted(bytes(r.r) for r in table.select(codec.encode_event().alias("r")).collect()) == sorted(record(*r) for r in rows)
    odd = spark.createDataFrame([(b"",), (None,), (b"\0\0\0\x08abcd",)], "r binary").select(codec.decode_event("r").alias("e")).collect()
    assert [r.e.valid for r in odd] == [False] * 3


def test_dump_has_headers_events_and_totals(spark, tmp_path):
    events = spark.sql("SELECT 's' stream, CAST(id AS INT) version, id sequence, timestamp_millis(id) ts, 't' type, 'd' data, 44 rec_size FROM range(5)")
    storage.dump_blocks(events, f"{tmp_path}/dump", budget=100)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/dump").collect()]
    assert sum(line.startswith("----- STREAM=s, START_VERSION=") for line in lines) == 3 and "TOTAL_BLOCKS: 3, TOTAL_ENTRIES: 5" in lines and len(lines) == 9


def test_more_hashes(spark):
    assert hashes.murmur3_128(b"hello", 0) == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19) and hashes.murmur3_128(b"", 0) == (0, 0)
    data = [b"", b"a", b"12345678", bytes(range(200)), None]
    found = spark.createDataFrame([(d,) for d in data], "d binary").select("d", hashes.xxhash32_udf("d").alias("x"), hashes.xxhash64_udf("d").alias("y"), hashes.murmur3_64_udf("d").alias("m"), hashes.murmur3_128_udf("d").alias("w")).collect()
    assert all((r.x is r.y is r.m is r.w is None) if r.d is None else len(r.w) == 16 and r.m is not None for r in found)
    assert len({r.m for r in found}) == len(data)


def test_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "p").write_text("# c\nstore.block.size = 10\n\nstore.on=true\nstore.name=a=b\n")
    file = config.properties(spark, str(tmp_path / "p"))
    assert config.setting(spark, "store.block.size", kind=int, file=file) == 10 and config.setting(spark, "store.on", kind=bool, file=file) is True and config.setting(spark, "store.name", file=file) == "a=b"
    monkeypatch.setenv("STORE_BLOCK_SIZE", "20")
    assert config.setting(spark, "store.block.size", kind=int, file=file) == 20
    spark.conf.set("store.block.size", "30")
    assert config.setting(spark, "store.block.size", kind=int, file=file) == 30 and config.setting(spark, "nothing", 1.5) == 1.5
    spark.conf.unset("store.block.size")


def test_one_writer_at_a_time(spark, tmp_path):
    one, other = EventStore(spark, str(tmp_path)), EventStore(spark, str(tmp_path))
    with one.locked():
        assert one.append_event("a", "t", "0") == 0
        for write in (lambda: other.append_event("a", "t", "1"), lambda: other.append(incoming(spark, ("a", "1", -1))), other.flush, other.compact):
            with pytest.raises(StoreLocked):
                write()
    assert other.append_event("a", "t", "1") == 1
    (tmp_path / "lock").touch()  # of a writer that died
    with pytest.raises(StoreLocked):
        one.append_event("a", "t", "2")
    assert one.repair() == 0 and one.append_event("a", "t", "2") == 2


def test_an_append_during_a_flush_is_kept(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    store.append_event("a", "t", "0")
    write_run = store._write_run

    def late(*args, **options):  # the lock is this object's, so the append gets in between listing and writing
        store._write_run = write_run
        store.append_event("a", "t", "1")
        return write_run(*args, **options)

    store._write_run = late
    store.flush()
    assert sorted(r.version for r in store.events().where("stream = 'a'").collect()) == [0, 1]
    assert store.append_event("a", "t", "2") == 2 and [r.version for r in store.log().where("stream = 'a'").collect()] == [0, 1, 2]


def test_a_crashed_append_is_not_read_and_written_over(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    store.append_event("a", "t", "0")
    torn = tmp_path / "log" / "batch=1"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"PAR1")
    assert store.last_sequence() == 0 and store.version("a") == 0
    assert store.append_event("a", "t", "1") == 1 and [r.data for r in store.log().collect()] == ["0", "1"]


def test_flushes_compact_and_log_files_roll(spark, tmp_path):
    store = EventStore(spark, str(tmp_path), compact_at=2, segment_rows=2)
    for i in range(3):
        store.append(spark.createDataFrame([("a", 5 * i + k, "t", "d") for k in range(5)], "stream string, pos long, type string, data string").coalesce(1))
        store.flush()
    assert sorted((r.level, r.idx) for r in store.segments().collect()) == [(0, 2), (1, 0)]
    assert store.version("a") == 14 and sorted(r.version for r in store.events().where("stream = 'a'").collect()) == list(range(15))
    assert len(list((tmp_path / "log" / "batch=0").glob("*.parquet"))) >= 3
    versions = store._versions(["a"])
    assert any("/versions/" in f for f in versions.inputFiles()) and not any("/runs/" in f for f in versions.inputFiles())  # a small append scans no run
    assert "EqualTo(stream,a)" in versions._jdf.queryExecution().toString()


def test_single_appends_of_many_threads_are_batched(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    with store.writer(wait=0.5) as writer:
        found = {}
        threads = [threading.Thread(target=lambda n=n: found.update({n: [writer.append(f"s{n % 2}", "t", f"{n}-{i}") for i in range(20)]})) for n in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        stale = writer.append("s0", "t", "x", expected=3)
    with pytest.raises(VersionMismatch):
        stale.result()
    with pytest.raises(ValueError):
        writer.append("s0", "t", "late")
    for stream in (0, 1):
        assert sorted(f.result() for n, own in found.items() if n % 2 == stream for f in own) == list(range(40))
    assert all([f.result() for f in own] == sorted(f.result() for f in own) for own in found.values())  # each thread's in its order
    assert len(store._batches()) <= 4 and store.invalid_events().count() == 0


def test_json_of_odd_events(spark):
    from weftline.functions.events import event_json

    rows = [('say "hi"\n\\', '{"a": "x\\"y", "b": [1, null]}'), ("t", 'plain "text"'), ("é", None), (None, "[]"), ("t", "12"), ("t", "")]
    events = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(rows)], "version int, type string, data string").withColumn("ts", F.timestamp_millis(F.lit(1234)))
    found = [json.loads(r.j) for r in events.select("version", event_json().alias("j")).orderBy("version").collect()]
    data = [{"a": 'x"y', "b": [1, None]}, 'plain "text"', None, [], 12, ""]
    assert found == [{"version": i, "timestamp": 1234, "type": t, "data": d} for i, ((t, _), d) in enumerate(zip(rows, data, strict=True))]


def test_codecs_and_stored_blocks(spark):
    for name in codecs.NAMES:
        for data in (b"", b"a", bytes(range(256)) * 50, b"x" * 100_000):
            assert codecs.unpack(codecs.pack(data, name), name, len(data)) == data
    assert len(codecs.pack(b"x" * 10_000, "LZ4")) < 200
    with pytest.raises(ValueError):
        codecs.compressed("GZ")
    events = spark.sql("SELECT 's' stream, CAST(id AS INT) version, id sequence, timestamp_millis(id) ts, 't' type, repeat('d', CAST(id AS INT)) data, CAST(43 + id AS INT) rec_size FROM range(20)")
    stored = blocks.stored_blocks(events, 200, "SNAPPY")
    assert stored.where("NOT codec = 'SNAPPY'").count() == 0 and blocks.block_valid(stored).where("NOT valid").count() == 0
    assert sorted((r.version, bytes(r.data)) for r in blocks.stored_events(stored).collect()) == [(i, b"d" * i) for i in range(20)]
    torn = stored.withColumn("body", F.expr("substring(body, 1, octet_length(body) - 2)"))
    assert blocks.block_valid(torn).where("valid").count() == 0 and blocks.stored_events(torn).count() == 0


class _Step:
    """Stands for a table; keeps the step that an operator runs in Python."""

    def select(self, *_):
        return self

    where = select

    def mapInArrow(self, step, schema):
        self.step = step
        return self


def test_stored_blocks_are_opened_a_part_at_once(spark):
    plain = (struct.pack(">i", 1024) + bytes(1020)) * 1024
    row = ("s", 0, 1024, len(plain), "LZ4", zlib.crc32(blocks.CHECKSUM_SEED + plain), codecs.pack(plain, "LZ4"))
    odd = [(*row[:5], row[5] + 1, row[6]), (*row[:3], None, *row[4:]), (*row[:6], None), (*row[:3], 1 << 62, "NONE", *row[5:]), (*row[:2], None, *row[3:]), (*row[:5], None, row[6]), (*row[:3], -1, "NONE", *row[5:])]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [field.split()[0] for field in blocks.STORED.split(", ")]
    batch, none = (pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names) for columns in (zip(*[row] * 20, *odd, *[row] * 20, strict=True), [()] * 7))
    for operator, column, counted in ((blocks.block_valid, "valid", bool), (blocks.stored_events, "records", len)):
        table = _Step()
        operator(table)
        tracemalloc.start()
        found = [counted(x.as_py()) for out in table.step(iter([batch, none])) for x in out[column]]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [bool(x) for x in found] == [True] * 20 + [False] * len(odd) + [True] * 20
        assert counted is bool or {x for x in found if x} == {1024}
        assert peak < 8 << 20  # the batch holds 40 MB
    whole = pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([plain] * (batch.num_rows - 1) + [None], pa.binary())], names)
    packed = list(blocks._packed(iter([whole]), "ZLIB"))
    assert len(packed) > 30 and [x for out in packed for x in out["body"].to_pylist()] == [codecs.pack(plain, "ZLIB")] * (batch.num_rows - 1) + [None]


def test_key_scan_is_by_signed_key(spark):
    events = spark.createDataFrame([("a", 1, 5), ("a", 0, 5), ("b", 0, -7), ("c", 0, 1 << 62)], "stream string, version int, h long")
    assert [(r.stream, r.version) for r in read.key_scan(events, F.col("h")).collect()] == [("b", 0), ("a", 0), ("a", 1), ("c", 0)]


def test_known_answers_of_hashes():
    assert hashes.murmur3_64(b"", 0) == 0 and hashes.crc32c(b"") == 0 and hashes.crc32c(b"a") == 0xC1D04330 and hashes.crc32c(bytes(32)) == 0x8A9136AA
