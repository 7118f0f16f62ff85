"""An event store in a folder: a log of appended events, sorted runs, and the list of live runs.

All of it is Parquet in a file system that Spark reads and writes. There is one writer at a time,
which a lock file sees to; readers see the state at the call, since no file that a live run or the log has is ever rewritten.
A run counts only once the segment log names it, together with the last sequence that the log had
then; what the log has beyond it is the memtable. So neither reads nor appends go over the log's
older batches, however long it gets: batches are folders named by their first sequence.
"""

from __future__ import annotations

import queue
import threading
import time
from concurrent.futures import Future
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.events import checksum, event_body, event_json, is_flush, is_valid
from weftline.operators import append as appends
from weftline.operators import lsm, read
from weftline.plans.lineage import checkpointed
from weftline.schema import FLUSH_TYPE, NO_SEQUENCE, NO_VERSION, PAGE, SYSTEM_STREAM, rec_size
from weftline.sources.storage import write_run

LOG = "stream string, version int, sequence long, ts timestamp, type string, data string, rec_size int, checksum long"
SEGMENTS = "pos long, op string, level int, idx long, upto long"
INCOMING = "stream string, pos long, type string, data string, expected int"
#: Streams of an append up to which their names are pushed into the scans of versions.
PUSHED = 1000


class State(NamedTuple):
    live: list[tuple[int, int]]
    ever: list[tuple[int, int]]
    upto: int
    next_pos: int


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class VersionMismatch(ValueError):
    """An event expected another version than its stream's next one."""


class StoreLocked(RuntimeError):
    """Another writer holds the store, or one that ended without letting go of it."""


class EventStore:
    """A store at ``path``; opening it needs no recovery, since its state is what complete files say.

    Appends, flushes and compactions hold the store's lock, a file that only one writer can create
    (as far as the file system creates files exclusively, as HDFS does). One that died leaves its
    lock and at most an incomplete batch, which nobody reads; ``repair`` removes both. With
    ``compact_at``, a flush merges full groups of so many runs; with ``segment_rows``, the log's files
    roll over after so many events.
    """

    def __init__(self, spark: SparkSession, path: str, compact_at: int | None = None, segment_rows: int = 0):
        self.spark, self.path, self.compact_at, self.segment_rows = spark, path.rstrip("/"), compact_at, segment_rows
        self._mine = threading.RLock()
        self._held = 0

    @contextmanager
    def locked(self):
        """Holds the store for this object; others that write get ``StoreLocked``."""
        files, path = self._folder("lock")
        with self._mine:
            if not self._held and not files.createNewFile(path):
                raise StoreLocked(f"{self.path} has another writer; if that is gone, repair() removes its lock")
            self._held += 1
            try:
                yield self
            finally:
                self._held -= 1
                if not self._held:
                    files.delete(path, False)

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, name: str, schema: str) -> DataFrame:
        files, path = self._folder(name)
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*_names(schema))  # without the batch

    # the log
    def log(self, after: int | None = None) -> DataFrame:
        """Events in append order, flush markers too; those after a sequence if one is given."""
        return read.log_scan(self._log_from(0), after)

    def tail(self) -> DataFrame:
        """The log as a stream, from its first event on."""
        return self.spark.readStream.schema(f"{LOG}, batch long").parquet(f"{self.path}/log").drop("batch")

    def _batches(self) -> list[int]:
        """First sequences of the log's complete batches, in order; one listing."""
        files, path = self._folder("log/batch=*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in files.globStatus(path) or [])

    def _log_from(self, batch: int) -> DataFrame:
        some = [f"{self.path}/log/batch={b}" for b in self._batches() if b >= batch]
        return self.spark.read.schema(LOG).parquet(*some) if some else self.spark.createDataFrame([], LOG)

    def last_sequence(self) -> int:
        last = self._log_from(max(self._batches(), default=0)).agg(F.max("sequence")).first()[0]
        return NO_SEQUENCE if last is None else last

    def _pending(self) -> DataFrame:
        """Events of the log that are in no run; the last flush's marker is one of them."""
        return self._log_from(self._state().upto + 1)

    def memtable(self) -> DataFrame:
        """Events that are in no run yet, without flush markers."""
        return self._pending().where(~is_flush())

    def repair(self) -> int:
        """Removes a lock and batches whose writer is gone; how many batches. Their events were never acknowledged.

        To be called only when no writer is at work.
        """
        files, path = self._folder("lock")
        files.delete(path, False)
        files, path = self._folder("log/batch=*")
        complete = set(self._batches())
        return sum(files.delete(f.getPath(), True) for f in files.globStatus(path) or [] if int(f.getPath().getName().removeprefix("batch=")) not in complete)

    def invalid_events(self) -> DataFrame:
        """Events of the log whose checksum is not that of what they hold."""
        return self._log_from(0).where(~is_valid())

    # reads
    def _segment_log(self) -> DataFrame:
        """The segment log; it has a few rows for each run that ever was."""
        return self.spark.createDataFrame(self._read("segments", SEGMENTS).collect(), SEGMENTS)

    def _state(self) -> State:
        """What the segment log says, read once: live runs, all runs ever, the last sequence in a run, the next position."""
        live, ever, upto, pos = {}, [], NO_SEQUENCE, -1
        for r in sorted(self._read("segments", SEGMENTS).collect(), key=lambda r: r["pos"]):
            run = r["level"], r["idx"]
            if (r["op"] == "ADD") == (run in live):
                raise ValueError(f"the segment log is not consistent at {r.asDict()}")
            if r["op"] == "ADD":
                live[run] = None
                ever.append(run)
            else:
                del live[run]
            upto, pos = max(upto, NO_SEQUENCE if r["upto"] is None else r["upto"]), r["pos"]
        return State(list(live), ever, upto, pos + 1)

    def segments(self) -> DataFrame:
        """(level, idx) of the live runs; an error if the segment log contradicts itself."""
        log = self._segment_log()
        wrong = lsm.invalid_segment_ops(log).first()
        if wrong is not None:
            raise ValueError(f"the segment log is not consistent at {wrong.asDict()}")
        return lsm.segment_state(log)

    def _sources(self) -> DataFrame:
        """Events of the memtable (level -1) and of all live runs, a key as often as it is there."""
        state = self._state()
        live = [f"{self.path}/runs/level={level}/idx={idx}" for level, idx in state.live]
        newest = self._log_from(state.upto + 1).withColumns({"level": F.lit(-1), "idx": F.lit(0).cast("long")})
        if not live:
            return newest
        return newest.unionByName(self.spark.read.schema(f"{LOG}, level int, idx long").option("basePath", f"{self.path}/runs").parquet(*live))

    def _versions(self, names: list[str] | None = None) -> DataFrame:
        """(stream, version): last versions in the memtable and in each live run; of some streams, which are pushed into the scans.

        A run has a table of its streams' last versions beside it, so no run's events are read.
        """
        state = self._state()
        tables = [f"{self.path}/versions/level={level}/idx={idx}" for level, idx in state.live]
        found = self._log_from(state.upto + 1).select("stream", "version")
        if tables:
            found = found.unionByName(self.spark.read.schema("stream string, version int").parquet(*tables))
        return found if names is None else found.where(F.col("stream").isin(names))

    def events(self) -> DataFrame:
        """All events, each key once: the memtable's before those of runs, low levels and new runs first."""
        return lsm.precedence(self._sources()).drop("level", "idx")

    def read(self, stream: str, from_version: int = 0, limit: int = PAGE) -> DataFrame:
        return read.read_page(self.events(), stream, from_version, limit)

    def status(self, stream: str, from_version: int = 0) -> int:
        """0 if a read from there has events, or why it has none."""
        return read.read_status(self.events(), self.spark.createDataFrame([(stream, from_version)], "stream string, version int")).first()["status"]

    def version(self, stream: str) -> int:
        return self._current([stream]).get(stream, NO_VERSION)

    def _current(self, names: list[str]) -> dict[str, int]:
        """Last versions of those of a few streams that are there."""
        return {r["stream"]: r["v"] for r in self._versions(names).groupBy("stream").agg(F.max("version").alias("v")).collect()}

    def read_json(self, stream: str, from_version: int = 0, limit: int = PAGE) -> str:
        """A page as a JSON array, at most ``limit`` events long; data that is no JSON is a text."""
        found = self.read(stream, from_version, limit).select("version", event_json().alias("body")).collect()
        return f"[{','.join(r['body'] for r in sorted(found, key=lambda r: r['version']))}]"

    # writes
    def append(self, incoming: DataFrame) -> DataFrame:
        """(stream, pos, expected, ok, version) for ``incoming(stream, pos, type, data[, expected])``.

        ``pos`` orders the events and occurs once in a stream. Accepted events are in the log when
        this returns. Without ``expected`` all are accepted and numbered in parallel. A batch has a
        folder of its own, named by its first sequence, that must not exist.
        """
        with self.locked():
            names = [r["stream"] for r in incoming.select("stream").distinct().limit(PUSHED + 1).collect()]
            current = self._versions(names if len(names) <= PUSHED else None)
            if "expected" in incoming.columns:
                decided = checkpointed(appends.append_expected(current, incoming))
                if decided.where("ok").isEmpty():
                    return decided
                accepted = incoming.select("stream", "pos", "type", "data").join(decided.where("ok").select("stream", "pos", "version"), ["stream", "pos"])
            else:
                accepted = checkpointed(appends.append_any(current, incoming.select("stream", "pos", "type", "data")))
                decided = accepted.select("stream", "pos", F.lit(NO_VERSION).alias("expected"), F.lit(True).alias("ok"), "version")
                if accepted.isEmpty():
                    return decided
            last = self.last_sequence()
            self._write_batch(appends.stamped(accepted, last), last + 1)
            return decided

    def _write_batch(self, stamped: DataFrame, first: int) -> None:
        files, path = self._folder(f"log/batch={first}")
        if files.exists(path) and first not in self._batches():
            files.delete(path, True)  # of a writer that died; this one holds the lock
        stamped.withColumn("rec_size", rec_size()).select(*_names(LOG)).write.mode("errorifexists").option("maxRecordsPerFile", self.segment_rows).parquet(f"{self.path}/log/batch={first}")

    def append_few(self, events: list[tuple[str, str, str, int]]) -> list[int | None]:
        """Versions of (stream, type, data, expected) events, appended in order as one batch; None for one that expected another."""
        with self.locked():
            current = self._current(sorted({e[0] for e in events}))
            versions, rows = [], []
            sequence = self.last_sequence() + 1
            for stream, type, data, expected in events:
                version = current.get(stream, NO_VERSION) + 1
                good = expected in (NO_VERSION, version)
                versions.append(version if good else None)
                if good:
                    current[stream] = version
                    rows.append((stream, version, sequence + len(rows), type, data))
            if rows:
                some = self.spark.createDataFrame(rows, "stream string, version int, sequence long, type string, data string").coalesce(1)
                self._write_batch(some.withColumn("ts", F.current_timestamp()).withColumn("checksum", checksum(event_body())), sequence)
            return versions

    def append_event(self, stream: str, type: str, data: str, expected: int = NO_VERSION) -> int:
        """Appends one event and returns its version; ``writer`` appends many single events together."""
        (version,) = self.append_few([(stream, type, data, expected)])
        if version is None:
            raise VersionMismatch(f"{stream} does not go on with version {expected}")
        return version

    def writer(self, most: int = 1000, wait: float = 0.05) -> BatchWriter:
        return BatchWriter(self, most, wait)

    def _log_segments(self, ops: list[tuple[str, int, int, int | None]]) -> None:
        """One file, so that its operations hold together or not at all."""
        pos = self._read("segments", SEGMENTS).agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0] + 1
        self.spark.createDataFrame([(pos + i, *op) for i, op in enumerate(ops)], SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _write_run(self, events: DataFrame, level: int, deleted: list[tuple[int, int]] = (), upto: int | None = None, partitions: int | None = None) -> tuple[int, int]:
        idx = max((i for own, i in self._state().ever if own == level), default=-1) + 1  # dead runs count too: readers may still have their files
        write_run(events, f"{self.path}/runs/level={level}/idx={idx}", level, partitions)
        written = self.spark.read.schema(LOG).parquet(f"{self.path}/runs/level={level}/idx={idx}")
        last = written.groupBy("stream").agg(F.max("version").alias("version")).sortWithinPartitions("stream")
        last.write.mode("overwrite").option("parquet.bloom.filter.enabled#stream", "true").parquet(f"{self.path}/versions/level={level}/idx={idx}")
        self._log_segments([*(("DELETE", *d, None) for d in deleted), ("ADD", level, idx, upto)])
        return level, idx

    def flush(self, partitions: int | None = None) -> tuple[int, int] | None:
        """Writes the memtable as a run of level 0 and marks that in the log; None if there is nothing to write."""
        with self.locked():
            pending = self._pending()  # the batches that are there now, and no later one
            upto, events = pending.agg(F.max("sequence"), F.count_if(~is_flush())).first()
            if not events:
                return None
            run = self._write_run(pending, 0, upto=upto, partitions=partitions)
            self.append_event(SYSTEM_STREAM, FLUSH_TYPE, "{}")
            if self.compact_at:
                self.compact(self.compact_at, partitions)
            return run

    def compact(self, threshold: int = 2, partitions: int | None = None) -> list[dict]:
        """Merges full groups of ``threshold`` runs of a level, oldest first, into one of the next level."""
        with self.locked():
            return self._compact(threshold, partitions)

    def _compact(self, threshold: int, partitions: int | None) -> list[dict]:
        plan = lsm.compaction_plan(self.segments(), threshold).collect()
        done = []
        for level, batch in sorted({(p["level"], p["batch"]) for p in plan}):
            sources = [(level, p["idx"]) for p in plan if (p["level"], p["batch"]) == (level, batch)]
            runs = self.spark.read.schema(f"{LOG}, level int, idx long").option("basePath", f"{self.path}/runs").parquet(*(f"{self.path}/runs/level={a}/idx={b}" for a, b in sources))
            level_to, idx = self._write_run(lsm.precedence(runs).drop("level", "idx"), level + 1, sources, partitions=partitions)
            done.append({"sources": sources, "level": level_to, "idx": idx})
        return done

    def vacuum(self) -> int:
        """Deletes the files of runs that are no longer live, which ends reads that began before; how many runs."""
        state = self._state()
        gone = 0
        for level, idx in set(state.ever) - set(state.live):
            files, path = self._folder(f"versions/level={level}/idx={idx}")
            files.delete(path, True)
            files, path = self._folder(f"runs/level={level}/idx={idx}")
            gone += files.delete(path, True)
        return gone


class BatchWriter:
    """Appends single events of any number of threads in batches of ``most``, or of what came within ``wait`` seconds.

    ``append`` gives a future of the event's version; a stale ``expected`` is its ``VersionMismatch``.
    To be closed, or used in a ``with``; closing writes what is waiting.
    """

    def __init__(self, store: EventStore, most: int, wait: float):
        self.store, self.most, self.wait = store, most, wait
        self._waiting: queue.Queue = queue.Queue()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def append(self, stream: str, type: str, data: str, expected: int = NO_VERSION) -> Future:
        if self._thread is None:
            raise ValueError("the writer is closed")
        found: Future = Future()
        self._waiting.put(((stream, type, data, expected), found))
        return found

    def _run(self) -> None:
        more = True
        while more:
            some = [self._waiting.get()]
            until = time.monotonic() + self.wait
            while some[-1] is not None and len(some) < self.most and (left := until - time.monotonic()) > 0:
                try:
                    some.append(self._waiting.get(timeout=left))
                except queue.Empty:
                    break
            more = some[-1] is not None
            self._write([x for x in some if x is not None])

    def _write(self, some: list[tuple[tuple, Future]]) -> None:
        try:
            versions = self.store.append_few([event for event, _ in some]) if some else []
        except Exception as error:  # the batch's events learn of it, the next batch is another matter
            for _, found in some:
                found.set_exception(error)
            return
        for (event, found), version in zip(some, versions, strict=True):
            if version is None:
                found.set_exception(VersionMismatch(f"{event[0]} does not go on with version {event[3]}"))
            else:
                found.set_result(version)

    def close(self) -> None:
        if self._thread is not None:
            thread, self._thread = self._thread, None
            self._waiting.put(None)
            thread.join()

    def __enter__(self) -> BatchWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()
