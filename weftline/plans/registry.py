"""All queries of the engine by name, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import codec, codecs
from weftline.functions import events as fn
from weftline.operators import append, blocks, lsm, ops, read, recover
from weftline.plans.lineage import shared_folder
from weftline.schema import read_events
from weftline.store import EventStore

QUERIES: dict = {}
SQL: dict = {}

EV = """ev AS (SELECT 'user-' || user_id AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS version,
  event_id AS sequence, ts, event_type AS type, props AS data,
  CAST(42 + octet_length(encode(event_type)) + octet_length(encode(props)) AS INTEGER) AS rec_size FROM events)"""


def crc(text: str) -> str:
    """SQL for the seeded CRC-32 of an ASCII text, a bit at a time."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    seed = ", ".join(f"CAST({b} AS BIGINT)" for b in fn.CHECKSUM_SEED)
    return f"xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT), {seed}] || list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda c, b: {step}))"


_BODY = "concat_ws(chr(31), stream, version, sequence, type, data)"
#: Bytes of a block in queries; the default holds most users' events in one.
BUDGET = 512
PACKED = f"""o AS (SELECT stream, version, rec_size FROM ev),
 fold AS (SELECT stream, version, version AS start_version, rec_size AS used FROM o WHERE version = 0
  UNION ALL SELECT o.stream, o.version, CASE WHEN f.used + o.rec_size > {BUDGET} THEN o.version ELSE f.start_version END,
   CASE WHEN f.used + o.rec_size > {BUDGET} THEN o.rec_size ELSE f.used + o.rec_size END
  FROM fold f JOIN o ON o.stream = f.stream AND o.version = f.version + 1),
 blocks AS (SELECT f.stream, f.start_version, CAST(count(*) AS INTEGER) AS entries, CAST(sum(o.rec_size) AS BIGINT) AS bytes
  FROM fold f JOIN o ON o.stream = f.stream AND o.version = f.version GROUP BY f.stream, f.start_version)"""
RUNS = """runs AS (SELECT stream, version, sequence, type, data, 0 AS level, CAST(version // 10 AS BIGINT) AS idx FROM ev
  UNION ALL SELECT stream, version, sequence, 'stale', data, 1, CAST(0 AS BIGINT) FROM ev WHERE version % 3 = 0)"""
SEGMENTS = "(0, 7), (0, 6), (0, 5), (0, 4), (0, 3), (1, 4), (1, 3), (1, 2), (2, 1), (2, 0)"
SEGMENT_LOG = "(1, 'ADD', 0, 1), (2, 'ADD', 0, 2), (3, 'ADD', 0, 3), (4, 'DELETE', 0, 1), (5, 'DELETE', 0, 2), (6, 'ADD', 1, 1), (7, 'ADD', 0, 3), (8, 'DELETE', 2, 9)"


def query(name: str, sql: str | None = None, ctes: str = EV):
    """Registers a query of (spark, sf_dir), and its SQL after the views it reads."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE {ctes} {sql}" if ctes else sql
        return f

    return add


def on_events(name: str, sql: str | None, f, ctes: str = EV) -> None:
    query(name, sql, ctes)(lambda spark, sf_dir: f(read_events(spark, sf_dir)))


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def segments(spark: SparkSession) -> DataFrame:
    return values(spark, SEGMENTS, "level, idx").select("level", F.col("idx").cast("long").alias("idx"))


def runs(events: DataFrame) -> DataFrame:
    own = events.select("stream", "version", "sequence", "type", "data", F.lit(0).alias("level"), F.floor(F.col("version") / 10).cast("long").alias("idx"))
    stale = events.where("version % 3 = 0").select("stream", "version", "sequence", F.lit("stale").alias("type"), "data", F.lit(1).alias("level"), F.lit(0).cast("long").alias("idx"))
    return own.unionByName(stale)


# scans and reads
on_events("log_scan", "SELECT stream, version, sequence, ts, type, data, rec_size FROM ev", read.log_scan)
on_events("log_scan_after", "SELECT stream, version, sequence FROM ev WHERE sequence > 500", lambda ev: read.log_scan(ev, 500).select("stream", "version", "sequence"))
on_events("read_page", "SELECT stream, version, sequence, type, data FROM ev WHERE stream = 'user-3' AND version >= 10 ORDER BY version LIMIT 1000", lambda ev: read.read_page(ev, "user-3", 10).select("stream", "version", "sequence", "type", "data"))
on_events("read_page_short", "SELECT stream, version, sequence FROM ev WHERE stream = 'user-5' AND version >= 3 ORDER BY version LIMIT 7", lambda ev: read.read_page(ev, "user-5", 3, 7).select("stream", "version", "sequence"))
on_events("stream_version", "SELECT stream, max(version) AS version FROM ev GROUP BY stream", read.stream_version)


@query("version_of", ", p(stream) AS (VALUES ('user-3'), ('ghost')) SELECT p.stream, CAST(coalesce(max(version), -1) AS INTEGER) AS version FROM p LEFT JOIN ev USING (stream) GROUP BY p.stream")
def version_of(spark, sf_dir):
    return read.version_of(read_events(spark, sf_dir), values(spark, "('user-3'), ('ghost')", "stream"))


@query("read_status", """, p(stream, version) AS (VALUES ('user-3', 0), ('user-3', 100000), ('ghost', 0)), c AS (SELECT stream, max(version) AS current FROM ev GROUP BY stream)
 SELECT p.stream, p.version, CASE WHEN current IS NULL THEN -11 WHEN p.version > current THEN -22 ELSE 0 END AS status FROM p LEFT JOIN c USING (stream)""")
def read_status(spark, sf_dir):
    return read.read_status(read_events(spark, sf_dir), values(spark, "('user-3', 0), ('user-3', 100000), ('ghost', 0)", "stream, version"))


_CTES = f"{EV}, {PACKED}"
#: Every event is sought, odd versions ten further on, among the first versions of all blocks.
_SOUGHT = ", k AS (SELECT stream, start_version AS version FROM blocks), p AS (SELECT stream, CAST(version + CASE WHEN version % 2 = 1 THEN 10 ELSE 0 END AS INTEGER) AS version FROM ev)"
_FOUND = {"equals": "LEFT JOIN k ON k.stream = p.stream AND p.version = k.version", **{how: f"ASOF LEFT JOIN k ON k.stream = p.stream AND p.version {sign} k.version" for how, sign in (("floor", ">="), ("ceiling", "<="), ("lower", ">"), ("higher", "<"))}}


def _starts(ev: DataFrame) -> DataFrame:
    return blocks.pack_blocks(ev, BUDGET).select("stream", F.col("start_version").alias("version"))


def _sought(ev: DataFrame) -> DataFrame:
    return ev.select("stream", F.expr("version + if(version % 2 = 1, 10, 0)").cast("int").alias("version"))


for _how in read.LOOKUPS:
    on_events(f"lookup_{_how}", f"{_SOUGHT} SELECT p.stream, p.version, k.version AS found FROM p {_FOUND[_how]}", lambda ev, how=_how: read.lookup(_starts(ev), _sought(ev), how), _CTES)
on_events("membership", f"{_SOUGHT} SELECT stream, version FROM p SEMI JOIN k USING (stream, version)", lambda ev: read.members(_sought(ev), _starts(ev)), _CTES)
on_events("type_filter", "SELECT stream, version, type FROM ev WHERE type IN ('error', 'purchase')", lambda ev: read.of_types(ev, "error", "purchase").select("stream", "version", "type"))
on_events("flush_events", "SELECT stream, version FROM ev WHERE stream = '_system' AND type = 'FLUSH' UNION ALL SELECT '_system', -1", lambda ev: read.flush_events(ev.select("stream", "version", "type").unionByName(ev.sparkSession.sql("SELECT '_system' stream, -1 version, 'FLUSH' type"))).select("stream", "version"))

# projections
on_events("event_fields", "SELECT stream, version, sequence, ts, rec_size, octet_length(encode(type)) AS type_length, octet_length(encode(data)) AS data_length FROM ev", lambda ev: ev.select("stream", "version", "sequence", "ts", "rec_size", F.octet_length("type").cast("long").alias("type_length"), F.octet_length("data").cast("long").alias("data_length")))
_MILLIS = "epoch_us(ts) // 1000"
on_events(
    "event_render",
    f"SELECT 'RECORD_SIZE=' || rec_size || ', CHECKSUM=' || {crc(_BODY)} || ', STREAM=' || stream || ', STREAM_HASH=' || {crc('stream')} || ', VERSION=' || version || ', SEQUENCE=' || sequence || ', TIMESTAMP=' || {_MILLIS} || ', TYPE=' || type || ', DATA=' || data AS text FROM ev",
    lambda ev: ev.select(fn.render_event(fn.checksum(F.encode("stream", "UTF-8"))).alias("text")),  # a key that SQL has too
)
on_events(
    "record_render",
    f"SELECT 'RECORD_SIZE=' || rec_size || ', CHECKSUM=' || {crc(_BODY)} || ', TIMESTAMP=' || {_MILLIS} || ', STREAM=' || stream || ', VERSION=' || version || ', SEQUENCE=' || sequence || ', TYPE_LENGTH=' || octet_length(encode(type)) || ', DATA_LENGTH=' || octet_length(encode(data)) || ', EVENT_TYPE=' || type || ', DATA_STRING=' || data AS text FROM ev",
    lambda ev: ev.select(fn.render_record().alias("text")),
)
on_events("key_text", "SELECT stream || '@' || version AS key FROM ev", lambda ev: ev.select(fn.key_text().alias("key")))
on_events(
    "http_read",
    f"""SELECT version, '{{"version":' || version || ',"timestamp":' || {_MILLIS} || ',"type":' || to_json(type || ' "' || version || '" ') || ',"data":' || json(data) || '}}' AS body FROM ev WHERE stream = 'user-3' AND version >= 0""",
    lambda ev: read.read_page(ev, "user-3").withColumn("type", F.concat("type", F.lit(' "'), F.col("version").cast("string"), F.lit('" '))).select("version", fn.event_json().alias("body")),
)
on_events("http_version", """SELECT stream, '{"version":' || max(version) || '}' AS body FROM ev GROUP BY stream""", lambda ev: read.stream_version(ev).select("stream", F.to_json(F.struct("version")).alias("body")))
on_events("json_extract", "SELECT stream, version, json_extract_string(data, '$.k') AS value FROM ev", ops.json_extract)
on_events("json_encode", """SELECT stream, version, '{"type":"' || type || '","version":' || version || '}' AS json FROM ev""", lambda ev: ops.json_encoded(ev, "type", "version"))
on_events("string_helpers", "SELECT stream, version, length(trim(data)) = 0 AS blank, octet_length(encode(data)) AS bytes, upper(type) AS shout FROM ev", lambda ev: ev.select("stream", "version", fn.is_blank("data").alias("blank"), fn.utf8_length("data").cast("long").alias("bytes"), F.upper(fn.require_not_blank("type")).alias("shout")))
on_events(
    "bit_helpers",
    "SELECT stream, version, CAST(pow(2, version % 40) AS BIGINT) - 1 AS most, length(CAST(sequence AS VARCHAR)) AS digits, lpad(bin(version), 16, '0') AS bits, CAST(bit_count(sequence) AS BIGINT) AS ones, sequence * 1048576 AS bytes FROM ev",
    lambda ev: ev.select("stream", "version", fn.max_value_of_bits(F.col("version") % 40).alias("most"), fn.decimal_digits("sequence").cast("long").alias("digits"), fn.bits_text("version", 16).alias("bits"), F.bit_count("sequence").cast("long").alias("ones"), fn.size_of("sequence", "MB").alias("bytes")),
)


@query("segment_id_text", f", s(level, idx) AS (VALUES {SEGMENTS}), t AS (SELECT lpad(CAST(level AS VARCHAR), 10, '0') || '-' || lpad(CAST(idx AS VARCHAR), 19, '0') AS id FROM s) SELECT id, CAST(split_part(id, '-', 1) AS INTEGER) AS level, CAST(split_part(id, '-', 2) AS BIGINT) AS idx FROM t")
def segment_id_text(spark, sf_dir):
    level, idx = fn.parse_segment_id("id")
    return segments(spark).select(fn.segment_id_text().alias("id")).select("id", level.alias("level"), idx.alias("idx"))


def _with_checksums(ev: DataFrame) -> DataFrame:
    return ev.withColumn("checksum", fn.checksum(fn.event_body()) + F.when(F.col("sequence") % 17 == 3, 1).otherwise(0))


on_events("valid_events", "SELECT stream, version, sequence FROM ev WHERE sequence % 17 <> 3", lambda ev: recover.valid_events(_with_checksums(ev)).select("stream", "version", "sequence"))
on_events("valid_prefix", "SELECT stream, version, sequence FROM ev WHERE sequence < (SELECT min(sequence) FROM ev WHERE sequence % 701 = 700)", lambda ev: recover.valid_prefix(ev.withColumn("valid", F.col("sequence") % 701 != 700), order="sequence").select("stream", "version", "sequence"))
on_events("last_flush", "SELECT coalesce(max(sequence) FILTER (type = 'error'), -1) AS last_flush, max(sequence) AS last_sequence FROM ev", lambda ev: recover.last_flush(ev, F.col("type") == "error"))
on_events("recover", "SELECT stream, version, sequence, type FROM ev WHERE sequence > (SELECT max(sequence) FROM ev WHERE type = 'error')", lambda ev: recover.to_replay(ev, F.col("type") == "error").select("stream", "version", "sequence", "type"))

# appends
_INCOMING = "SELECT stream, sequence AS pos, CAST(CASE sequence % 4 WHEN 0 THEN version WHEN 1 THEN version + 5 ELSE -1 END AS INTEGER) AS expected"
on_events(
    "append_any",
    ", c AS (SELECT stream, max(version) AS current FROM ev GROUP BY stream) SELECT stream, ev.sequence AS pos, CAST(c.current + row_number() OVER (PARTITION BY stream ORDER BY ev.sequence) AS INTEGER) AS version FROM ev JOIN c USING (stream)",
    lambda ev: append.append_any(ev, ev.select("stream", F.col("sequence").alias("pos"))).select("stream", "pos", "version"),
)
on_events(
    "append_expected",
    f""", inc AS ({_INCOMING}, version AS nth FROM ev),
 r AS (SELECT stream, nth, pos, expected, expected IN (-1, 0) AS ok, CASE WHEN expected IN (-1, 0) THEN 0 ELSE -1 END AS cur FROM inc WHERE nth = 0
  UNION ALL SELECT i.stream, i.nth, i.pos, i.expected, i.expected = -1 OR i.expected = r.cur + 1, CASE WHEN i.expected = -1 OR i.expected = r.cur + 1 THEN r.cur + 1 ELSE r.cur END
  FROM r JOIN inc i ON i.stream = r.stream AND i.nth = r.nth + 1)
 SELECT stream, pos, expected, ok, CAST(CASE WHEN ok THEN cur END AS INTEGER) AS version FROM r""",
    lambda ev: append.append_expected(ev.where("false"), ev.selectExpr("stream", "sequence AS pos", "CAST(CASE sequence % 4 WHEN 0 THEN version WHEN 1 THEN version + 5 ELSE -1 END AS INT) AS expected")),
)
on_events("append_stamped", ", m AS (SELECT max(sequence) AS m FROM ev) SELECT stream, version, row_number() OVER (ORDER BY ev.sequence) + m AS sequence FROM ev, m", lambda ev: append.stamped(ev.withColumn("pos", F.col("sequence")).drop("sequence"), ev.agg(F.max("sequence")).first()[0]).select("stream", "version", "sequence"))

# blocks
_CTES = f"{EV}, {PACKED}"
on_events("block_pack", "SELECT stream, start_version, entries, bytes FROM blocks", lambda ev: blocks.pack_blocks(ev, BUDGET), _CTES)
on_events("block_explode", "SELECT f.stream, f.start_version, f.version, ev.sequence, ev.type, ev.data, ev.rec_size FROM fold f JOIN ev USING (stream, version)", lambda ev: blocks.explode_blocks(blocks.block_bodies(ev, BUDGET)), _CTES)
on_events("read_block", "SELECT * FROM blocks WHERE stream = 'user-3' AND start_version <= 25 AND 25 < start_version + entries", lambda ev: blocks.read_block(blocks.pack_blocks(ev, BUDGET), "user-3", 25), _CTES)
on_events(
    "block_render",
    f"SELECT 'STREAM=' || stream || ', START_VERSION=' || start_version || ', ENTRIES=' || entries || ', UNCOMPRESSED_SIZE=' || bytes || ', BLOCK_SIZE=' || bytes + 29 || ', STREAM_HASH=' || {crc('stream')} || ', CHECKSUM=' || {crc('concat_ws(chr(31), stream, start_version, entries, bytes)')} || ', CODEC=NONE' AS text FROM blocks",
    lambda ev: blocks.pack_blocks(ev, BUDGET).select(fn.render_block(fn.checksum(F.encode("stream", "UTF-8"))).alias("text")),
    _CTES,
)
on_events("block_valid", "SELECT stream, start_version, start_version % 3 <> 1 AS valid FROM blocks", lambda ev: blocks.block_valid(blocks.stored_blocks(ev, BUDGET).withColumn("checksum", F.when(F.col("start_version") % 3 == 1, F.col("checksum") + 1).otherwise(F.col("checksum")))), _CTES)
on_events("stored_events", "SELECT f.stream, f.start_version, f.version, ev.sequence, ev.type, ev.data, ev.rec_size FROM fold f JOIN ev USING (stream, version)", lambda ev: blocks.stored_events(blocks.stored_blocks(ev, BUDGET, "ZLIB")).select("stream", "start_version", "version", "sequence", "type", F.col("data").cast("string").alias("data"), "rec_size"), _CTES)
on_events(
    "block_codecs",
    f"SELECT stream, version, codec, octet_length(encode(data)) AS size, true AS same FROM ev, (VALUES {', '.join(f'({n!r})' for n in codecs.NAMES)}) t(codec)",
    lambda ev: reduce(DataFrame.unionByName, (ev.select("stream", "version", F.lit(n).alias("codec"), F.octet_length("data").cast("long").alias("size"), (codecs.decompressed(n)(codecs.compressed(n)(F.encode("data", "UTF-8")), F.octet_length("data")) == F.encode("data", "UTF-8")).alias("same")) for n in codecs.NAMES)),
)
on_events("key_scan", f"SELECT stream, version, {crc('stream')} - 2147483648 AS stream_hash FROM ev", lambda ev: read.key_scan(ev, fn.checksum(F.encode("stream", "UTF-8")) - 2147483648).select("stream", "version", "stream_hash"))
on_events("index_counts", "SELECT stream, count(*) AS sparse_entries, CAST(sum(entries) AS BIGINT) AS dense_entries FROM blocks GROUP BY stream", lambda ev: blocks.index_counts(blocks.pack_blocks(ev, BUDGET)), _CTES)
on_events("dump_summary", "SELECT count(*) AS blocks, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM blocks", lambda ev: ops.dump_summary(blocks.pack_blocks(ev, BUDGET)), _CTES)

# runs and segments
_CTES = f"{EV}, {RUNS}"
on_events("merge_runs", "SELECT stream, version, type, level AS run FROM runs", lambda ev: lsm.merge_runs(runs(ev).withColumn("run", F.col("level"))).select("stream", "version", "type", "run"), _CTES)
_FIRST = "QUALIFY row_number() OVER (PARTITION BY stream, version ORDER BY level, idx DESC) = 1"
on_events("lsm_precedence", f"SELECT stream, version, sequence, type, data, level, idx FROM runs {_FIRST}", lambda ev: lsm.precedence(runs(ev)), _CTES)
on_events("compact", f"SELECT stream, version, sequence, type, data FROM runs {_FIRST}", lambda ev: lsm.compact(runs(ev)), _CTES)
on_events("compaction_stats", "SELECT idx AS job, count(*) AS sources, CAST(sum(rec_size) AS BIGINT) AS source_bytes, CAST(least(count(*), 2147483647) AS BIGINT) AS expected_entries FROM (SELECT CAST(version // 10 AS BIGINT) AS idx, rec_size FROM ev) GROUP BY idx", lambda ev: lsm.compaction_stats(ev.select(F.floor(F.col("version") / 10).cast("long").alias("job"), F.lit(1).cast("long").alias("entries"), F.col("rec_size").cast("long").alias("bytes"))))

_S = f"s AS (SELECT CAST(level AS INTEGER) AS level, CAST(idx AS BIGINT) AS idx FROM (VALUES {SEGMENTS}) t(level, idx)), h AS (SELECT * FROM s ORDER BY level, idx DESC LIMIT 1)"


def on_segments(name: str, sql: str, f) -> None:
    query(name, sql, _S)(lambda spark, sf_dir: f(segments(spark)))


def _some(s: DataFrame, condition: str) -> DataFrame:
    return s.where(condition)


on_segments("segment_order", "SELECT level, idx, row_number() OVER (ORDER BY level, idx DESC) - 1 AS place FROM s", lambda s: lsm.segment_order(s).withColumn("place", F.col("place").cast("long")))
on_segments("segment_order_reverse", "SELECT level, idx, row_number() OVER (ORDER BY level DESC, idx) - 1 AS place FROM s", lambda s: lsm.segment_order(s, reverse=True).withColumn("place", F.col("place").cast("long")))
on_segments("view_head", "SELECT * FROM h", lsm.view_head)
on_segments("view_tail", "SELECT * FROM s ORDER BY level DESC, idx LIMIT 1", lsm.view_tail)
on_segments("view_get", "SELECT * FROM s ORDER BY level, idx DESC LIMIT 1 OFFSET 3", lambda s: lsm.view_get(s, 3))
on_segments("view_add", "SELECT * FROM s UNION ALL SELECT 3, 0", lambda s: lsm.view_add(s, s.sparkSession.sql("SELECT 3 level, 0L idx")))
on_segments("view_delete", "SELECT * FROM s WHERE level <> 1", lambda s: lsm.view_delete(s, _some(s, "level = 1")))
on_segments("view_replace", "SELECT * FROM s WHERE level <> 1 UNION ALL SELECT 2, 2", lambda s: lsm.view_replace(s, _some(s, "level = 1"), s.sparkSession.sql("SELECT 2 level, 2L idx")))
on_segments("level_segments", "SELECT * FROM s WHERE level = 1", lambda s: lsm.level_segments(s, 1))
on_segments("max_level", "SELECT max(level) AS max_level FROM s", lsm.max_level)
on_segments("next_idx", "SELECT l.level, CAST(coalesce(max(idx), -1) + 1 AS BIGINT) AS next_idx FROM (VALUES (0), (1), (2), (3)) l(level) LEFT JOIN s USING (level) GROUP BY l.level", lambda s: lsm.next_idx(s, s.sparkSession.range(4).selectExpr("CAST(id AS INT) AS level")))
on_segments("compaction_eligible", "SELECT * FROM s WHERE NOT (level = 1 AND idx = 2) EXCEPT SELECT * FROM h", lambda s: lsm.eligible(s, _some(s, "level = 1 AND idx = 2")))
on_segments("compaction_plan", ", n AS (SELECT level, idx, CAST((row_number() OVER (PARTITION BY level ORDER BY idx) - 1) // 2 AS INTEGER) AS batch FROM (SELECT * FROM s EXCEPT SELECT * FROM h)) SELECT level, batch, idx FROM n QUALIFY count(*) OVER (PARTITION BY level, batch) = 2", lsm.compaction_plan)

_L = f"l AS (SELECT CAST(pos AS INTEGER) AS pos, op, CAST(level AS INTEGER) AS level, CAST(idx AS INTEGER) AS idx FROM (VALUES {SEGMENT_LOG}) t(pos, op, level, idx))"


@query("segment_state", "SELECT level, idx FROM l QUALIFY row_number() OVER (PARTITION BY level, idx ORDER BY pos DESC) = 1 AND op = 'ADD'", _L)
def segment_state(spark, sf_dir):
    return lsm.segment_state(values(spark, SEGMENT_LOG, "pos, op, level, idx"))


@query("segment_log_invalid", "SELECT pos, op, level, idx FROM l QUALIFY op = coalesce(lag(op) OVER (PARTITION BY level, idx ORDER BY pos), 'DELETE')", _L)
def segment_log_invalid(spark, sf_dir):
    return lsm.invalid_segment_ops(values(spark, SEGMENT_LOG, "pos, op, level, idx"))


# sequences and aggregates
on_events("batching", "SELECT stream, version, (row_number() OVER (PARTITION BY stream ORDER BY version) - 1) // 16 AS batch FROM ev", lambda ev: ops.batching(ev.select("stream", "version"), 16, "stream", "version"))
on_events("buffering", "SELECT stream, version FROM ev", lambda ev: ops.buffering(ev.select("stream", "version"), 64))
on_events("peek", "SELECT stream, version, lead(version) OVER (PARTITION BY stream ORDER BY version) AS peek FROM ev", lambda ev: ops.peeking(ev.select("stream", "version")))
on_events("concat", "SELECT stream, version, 0 AS part FROM ev WHERE type = 'error' UNION ALL SELECT stream, version, 1 FROM ev WHERE type = 'click'", lambda ev: ops.concat(*(ev.where(F.col("type") == t).select("stream", "version") for t in ("error", "click"))))
on_events("round_robin", "SELECT stream, version, 0 AS part FROM ev UNION ALL SELECT stream, version, 1 FROM ev", lambda ev: ops.round_robin(*[ev.select("stream", "version")] * 2))
on_events("cycle", "SELECT stream, version, CAST(r AS INTEGER) AS round FROM ev, range(3) t(r)", lambda ev: ops.cycle(ev.select("stream", "version"), 3))
on_events("gap_check", "SELECT stream, version, before FROM (SELECT stream, version, lag(version) OVER (PARTITION BY stream ORDER BY version) AS before FROM ev WHERE version % 7 <> 3) WHERE version - before > 1", lambda ev: ops.gap_check(ev.where("version % 7 <> 3")))
on_events("renumber", "SELECT stream, sequence, CAST(row_number() OVER (PARTITION BY stream ORDER BY sequence) - 1 AS INTEGER) AS version FROM ev WHERE type <> 'view'", lambda ev: ops.renumbered(ev.where("type <> 'view'").select("stream", "sequence", "version")))
on_events("table_stats", "SELECT count(*) AS entries, CAST(sum(rec_size) AS BIGINT) AS bytes, count(DISTINCT stream) AS streams FROM ev", ops.table_stats)
on_events(
    "metrics_merge",
    "SELECT name, CAST(sum(value) AS BIGINT) AS value FROM (SELECT type AS name, count(*) AS value FROM ev GROUP BY type UNION ALL SELECT type, sum(rec_size) FROM ev GROUP BY type) GROUP BY name",
    lambda ev: ops.metrics_merge(ev.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("value")), ev.groupBy(F.col("type").alias("name")).agg(F.sum("rec_size").alias("value"))),
)
on_events("metric_get", "SELECT CAST(0 AS BIGINT) AS value", lambda ev: ops.metric(ev.select(F.col("type").alias("name"), F.col("version").alias("value")), "missing"))
on_events("stream_keys", None, lambda ev: _keys(ev))


def _keys(ev: DataFrame) -> DataFrame:
    from weftline.functions.hashes import adler32_udf, crc32c_udf, stream_key_udf

    body = F.encode("data", "UTF-8")
    return ev.select("stream", "version", stream_key_udf("stream").alias("stream_hash"), F.crc32(body).alias("crc32"), crc32c_udf(body).alias("crc32c"), adler32_udf(body).alias("adler32"))


# the binary form of events
on_events(
    "record_codec",
    "SELECT stream, version, sequence, epoch_us(ts) // 1000 AS millis, type, data, rec_size, true AS valid FROM ev",
    lambda ev: ev.withColumn("stream_hash", F.xxhash64("stream")).select("stream", codec.decode_event(codec.encode_event()).alias("e")).select("stream", "e.version", "e.sequence", F.unix_millis("e.ts").alias("millis"), "e.type", F.col("e.data").cast("string").alias("data"), "e.rec_size", "e.valid"),
)
on_events("bit_sets", "SELECT stream, version, CAST(version AS BIGINT) AS same, CAST(bit_count(version) AS BIGINT) AS ones FROM ev", lambda ev: ev.withColumn("bits", codec.to_bits("version", 32)).select("stream", "version", codec.from_bits("bits").alias("same"), F.size(F.filter("bits", lambda b: b)).cast("long").alias("ones")))


# streaming, run to the end of what is there
def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{next(_numbers)}"


_numbers = iter(range(1 << 30))


@query("tail", "SELECT stream, version, sequence, type, data FROM ev")
def tail(spark, sf_dir):
    from weftline.streaming import streams

    at = _shared(spark, "tail")
    events = read_events(spark, sf_dir).select("stream", "version", "sequence", "type", "data")
    for part in ("sequence % 2 = 0", "sequence % 2 = 1"):  # the second call goes on where the first one ended
        events.where(part).write.mode("append").parquet(f"{at}/log")
        streams.run_available(streams.tail(spark, f"{at}/log", events.schema), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query("stream_append", "SELECT stream, version, sequence AS pos FROM ev")
def stream_append(spark, sf_dir):
    from weftline.streaming import streams

    at = _shared(spark, "append")
    incoming = read_events(spark, sf_dir).select("stream", F.col("sequence").alias("pos"), "type", "data")
    half = incoming.agg((F.max("pos") / 2).cast("long")).first()[0]
    for part in (F.col("pos") <= half, F.col("pos") > half):
        incoming.where(part).write.mode("append").parquet(f"{at}/in")
        streams.append_batches(streams.tail(spark, f"{at}/in", incoming.schema), f"{at}/log", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/log").select("stream", "version", "pos")


# the store: events appended in parts, flushed and compacted in between
def filled_store(spark: SparkSession, sf_dir: str) -> EventStore:
    """Four parts are appended; three become runs, of which two are merged, and one stays in the memtable."""
    store = EventStore(spark, _shared(spark, "store"))
    incoming = read_events(spark, sf_dir).select("stream", F.col("sequence").alias("pos"), "type", "data")
    quarter = incoming.agg((F.max("pos") / 4).cast("long")).first()[0] + 1
    for part in range(4):
        store.append(incoming.where(F.floor(F.col("pos") / quarter) == part))
        if part < 3:
            store.flush()
    store.compact()
    return store


@query("store_read", "SELECT stream, version, type, data FROM ev")
def store_read(spark, sf_dir):
    return filled_store(spark, sf_dir).events().where("stream <> '_system'").select("stream", "version", "type", "data")


@query("store_log", "SELECT stream, version, type, data FROM ev UNION ALL SELECT '_system', 0, 'FLUSH', '{}' UNION ALL SELECT '_system', 1, 'FLUSH', '{}' UNION ALL SELECT '_system', 2, 'FLUSH', '{}'")
def store_log(spark, sf_dir):
    return filled_store(spark, sf_dir).log().select("stream", "version", "type", "data")


@query("store_segments", "SELECT * FROM (VALUES (0, CAST(2 AS BIGINT)), (1, CAST(0 AS BIGINT))) t(level, idx)", "")
def store_segments(spark, sf_dir):
    return filled_store(spark, sf_dir).segments()
