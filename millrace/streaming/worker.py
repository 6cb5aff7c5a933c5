"""A consumer as a streaming query: user code per shard, acknowledged by the batch's commit."""

from __future__ import annotations

import asyncio
import inspect
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.functions.codec import record_of
from millrace.operators.delivery import Deferral
from millrace.operators.leases import LeaseStore, Row
from millrace.schema import LATEST, LEADER_KEY, ConsumerOptions
from millrace.session import ship_package
from millrace.sources.shardlog import Catalog, register
from millrace.streaming.metrics import MetricsSink, Totals

__all__ = ["ChangeProcessor", "MetricsSink", "NotAcknowledged", "Totals", "Worker", "process"]


class NotAcknowledged(RuntimeError):
    """A processor did not acknowledge a batch: it is delivered again."""


class ChangeProcessor(Protocol):
    """User code for one shard. Only ``process_records`` is needed; it may be a coroutine.

    It gets records as dicts of shard_id, seq, data and event; event is the typed change where data is one, its images
    in the options' record format. Returning False or raising fails the batch, and the same rows come again; returning
    a sequence number acknowledges up to it, and the rest comes again at once; anything else acknowledges all.
    Delivery is at least once: sinks are to be idempotent by shard and sequence number.

    A processor serves its shard for as long as the Python worker process lives that it was made in; another process
    makes another one.
    """

    def process_records(self, shard: str, records: list[dict]) -> Any: ...

    # Optional: initialize(shard), shard_ended(shard), shutdown_requested(shard), lease_lost(shard).


Factory = Callable[[], ChangeProcessor]
#: Processors of this process, by consumer and shard.
_LIVE: dict[tuple[str, str], Any] = {}


def _user(token: str, shard: str, factory: Factory) -> Any:
    if (token, shard) not in _LIVE:
        user = factory()
        _hook(user, "initialize", shard)
        _LIVE[token, shard] = user
    return _LIVE[token, shard]


def _waited(got: Any) -> Any:
    async def outcome() -> Any:
        return await got

    return asyncio.run(outcome()) if inspect.isawaitable(got) else got


def _hook(user: Any, name: str, shard: str) -> None:
    if hasattr(user, name):
        _waited(getattr(user, name)(shard))


class _Listener(StreamingQueryListener):
    def __init__(self, sink: MetricsSink) -> None:
        self.sink = sink

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.sink.progress(event.progress.batchId, {k: v.asDict() for k, v in event.progress.observedMetrics.items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


REPORT = "shard_id string, generation int, records bigint, bytes bigint, checkpoint string, created_ms bigint, waited_ms bigint, ended boolean"
_REPORT = pa.schema([("shard_id", pa.string()), ("generation", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("checkpoint", pa.string()), ("created_ms", pa.int64()), ("waited_ms", pa.int64()), ("ended", pa.bool_())])


def process(rows: DataFrame, factory: Factory, max_records: int, record_format: str = "native", token: str = "", due_ms: int | None = None) -> DataFrame:
    """Run user code over rows that are sorted by shard and sequence; a report per shard.

    A processor gets at most ``max_records`` records at a time. ``due_ms``: when the rows were there, for the wait of
    each shard until its turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reports: list[dict] = []
        now: dict | None = None
        held: list[dict] = []

        def flush() -> None:
            rest = list(held)
            held.clear()
            while rest:
                try:
                    got = _waited(_user(token, now["shard_id"], factory).process_records(now["shard_id"], list(rest)))
                except BaseException:
                    _LIVE.pop((token, now["shard_id"]), None)
                    raise
                upto = next((k for k, r in enumerate(rest) if r["seq"] == got), -1) + 1 if isinstance(got, str) else 0 if got is False else len(rest)
                if not upto:
                    raise NotAcknowledged(now["shard_id"])
                for r in rest[:upto]:
                    now["records"] += 1
                    now["bytes"] += len((r["data"] or "").encode())
                    if r["event"] and r["event"]["approx_creation_time_ms"] is not None:
                        now["created_ms"] = r["event"]["approx_creation_time_ms"]
                now["checkpoint"] = rest[upto - 1]["seq"]
                rest = rest[upto:]

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in ("shard_id", "generation", "seq", "data", "shard_end"))
            for shard, generation, seq, data, end in zip(*columns, strict=True):
                if now is None or now["shard_id"] != shard:
                    flush()
                    waited = max(0, int(time.time() * 1000) - due_ms) if due_ms is not None else None
                    now = {"shard_id": shard, "generation": generation, "records": 0, "bytes": 0, "checkpoint": None, "created_ms": None, "waited_ms": waited, "ended": False}
                    reports.append(now)
                if end:
                    flush()
                    now["ended"] = True
                    _hook(_user(token, shard, factory), "shard_ended", shard)
                    _LIVE.pop((token, shard), None)
                else:
                    held.append({"shard_id": shard, "seq": seq, "data": data, "event": record_of(data, record_format)})
                    if len(held) >= max_records:
                        flush()
        flush()
        if reports:
            yield pa.RecordBatch.from_pylist(reports, schema=_REPORT)

    return rows.mapInArrow(run, REPORT)


def signal(shards: DataFrame, factory: Factory, name: str, token: str) -> DataFrame:
    """Call a hook for each shard, on the processor that lives in the process or a new one, which then goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                _hook(_user(token, shard, factory), name, shard)
                _LIVE.pop((token, shard), None)
            yield batch

    return shards.select("shard_id").mapInArrow(run, "shard_id string")


class Worker:
    """Consumes a shard log: ordered within a shard, children after their parents, at least once.

    ``state`` is the query's checkpoint folder. ``run`` returns after all that is there (``once``) or after ``stop``.
    With a lease ``store`` the worker leads the sync of the catalogue, holds a lease for each shard it has begun, writes
    acknowledged sequence numbers there (deferred, if the options ask for it), completes leases at shard ends, removes
    those that are safe to delete, and releases the others when it stops. A shard whose lease another one has taken is
    no longer delivered here.
    """

    def __init__(
        self, spark: SparkSession, path: str, state: str, factory: Factory, options: ConsumerOptions | None = None, metrics: MetricsSink | None = None, max_bytes: int | None = None, store: LeaseStore | None = None, now_ms: Callable[[], int] | None = None
    ) -> None:
        self.spark, self.path, self.state, self.factory = spark, path, state, factory
        self.options, self.metrics, self.max_bytes = options or ConsumerOptions(), metrics or MetricsSink(), max_bytes
        self.store, self.now_ms = store, now_ms or (lambda: int(time.time() * 1000))
        self.checkpoints: dict[str, str] = {}
        self.owned: set[str] = set()
        self.lost: set[str] = set()
        self.query: StreamingQuery | None = None
        self.token = uuid.uuid4().hex
        self.leading = False
        self._deferral = Deferral(self.options.checkpoint_interval_ms or 0)
        self._held: dict[str, Row] = {}
        self._leader_seen: tuple[int, int] | None = None
        self._cycled = -(10**18)
        self._stopping = threading.Event()
        self._batches = 0

    # --- Stream ---------------------------------------------------------------------------------------------------

    def stream(self) -> DataFrame:
        ship_package(self.spark)
        register(self.spark)
        reader = self.spark.readStream.format("shardlog").option("path", self.path).option("initialPosition", self.options.initial_position)
        if self.store is not None:
            # A worker with leases holds so many at most.
            reader = reader.option("maxShards", self.options.max_leases)
        if self.max_bytes:
            reader = reader.option("maxBytesPerShard", self.max_bytes)
        counted = F.count_if(~F.col("shard_end"))
        return reader.load().observe("consumer", counted.alias("records_processed"), F.sum(F.octet_length("data")).alias("bytes_processed"), F.count_if("shard_end").alias("shard_end_count"))

    def _batch(self, rows: DataFrame, batch: int) -> None:
        self._batches += 1
        self.cycle()
        ordered = rows.where(~F.col("shard_id").isin(sorted(self.lost))) if self.lost else rows
        most = self.options.max_concurrency
        if most:
            # As many tasks as shards may be processed at a time.
            ordered = ordered.repartition(most, "shard_id")
        self.metrics.record("max_concurrency", most or 0)
        ordered = ordered.sortWithinPartitions("shard_id", "shard_end", F.length("seq"), "seq")
        # A report is a row per shard of the batch, the same bound as the offset's.
        reports = process(ordered, self.factory, self.options.max_records, self.options.record_format, self.token, self.now_ms()).collect()
        self.metrics.record("queue_depth", len(reports))
        for r in reports:
            self._acknowledge(r)
        self.metrics.record("lease_held", len(self.owned))

    def _acknowledge(self, r) -> None:
        shard, now = r["shard_id"], self.now_ms()
        if self.store is not None and shard not in self._held and not self._take(shard):
            self._lose(shard)
            return
        self.owned.add(shard)
        if r["records"]:
            lag = max(0, now - r["created_ms"]) if r["created_ms"] is not None else None
            self.checkpoints[shard] = r["checkpoint"]
            self.metrics.batch(shard, r["records"], r["bytes"], lag)
            self.metrics.record("records_processed", r["records"], shard)
            self.metrics.record("bytes_processed", r["bytes"], shard)
            if lag is not None:
                self.metrics.record("millis_behind_latest", lag, shard)
            self._checkpoint(shard, self._deferral.acknowledge(shard, r["checkpoint"], now))
        if r["waited_ms"] is not None:
            self.metrics.record("slot_wait_ms", r["waited_ms"], shard)
        if r["ended"]:
            self._checkpoint(shard, self._deferral.flush(shard))
            self._guarded(shard, "complete")
            self.owned.discard(shard)
            self._held.pop(shard, None)
            self.metrics.shard_ended(shard)
            self.metrics.record("shard_end_count", 1, shard)

    # --- Leases ---------------------------------------------------------------------------------------------------

    def cycle(self) -> None:
        """Leader's sync and cleanup, at most once in a cycle's interval; only with a store."""
        now = self.now_ms()
        if self.store is None or now - self._cycled < self.options.cycle_interval_ms:
            return
        self._cycled = now
        self.leading = self._lead(now)
        if self.leading:
            self.metrics.record("catalog_scans", 1)
            self._sync(Catalog(self.path))

    def _lead(self, now: int) -> bool:
        row, me = self.store.get(LEADER_KEY), self.options.owner
        if row is None:
            return self.store.run(LEADER_KEY, "lead", me)[1]
        if row.owner == me:
            return self.store.run(LEADER_KEY, "renew", me, row.counter)[1]
        if self._leader_seen is None or self._leader_seen[0] != row.counter:
            self._leader_seen = (row.counter, now)
        expired = now - self._leader_seen[1] > self.options.lease_duration_ms
        return (row.owner is None or expired) and self.store.run(LEADER_KEY, "lead", me, row.counter)[1]

    def _sync(self, catalog: Catalog) -> None:
        """A lease for each shard whose parents are complete or gone; no lease for a completed shard all whose children have begun."""
        rows = {r[0]: Row(*r[1:5]) for r in self.store.rows()}
        children: dict[str, list[str]] = {}
        for s, parents in catalog.parents.items():
            for p in parents:
                children.setdefault(p, []).append(s)
        for s, parents in catalog.parents.items():
            # A shard that has no lease but children with one has had its own and lost it to the cleanup.
            if s not in rows and all(p not in rows or rows[p].completed for p in parents) and not any(c in rows for c in children.get(s, ())):
                seeds = [rows[p].checkpoint for p in parents if p in rows]
                seed = LATEST if seeds and all(x == LATEST for x in seeds) or not parents and self.options.initial_position == LATEST else None
                self.store.run(s, "create", seq=seed, parents=parents)
        begun = {s for s, r in rows.items() if r.completed or r.checkpoint not in (None, LATEST)}
        for s, r in rows.items():
            if r.completed and children.get(s) and all(c in begun for c in children[s]):
                self.store.run(s, "delete")

    def _take(self, shard: str) -> bool:
        """Hold the shard's lease: a new or free one, or one's own from before; False where another worker has it."""
        row, me = self.store.get(shard), self.options.owner
        if row is None:
            self.store.run(shard, "create")
            row = self.store.get(shard)
        if row.owner not in (None, me):
            return False
        held, ok = self.store.run(shard, "claim", me, row.counter)
        if ok:
            self._held[shard] = held
            self.metrics.record("lease_acquired", 1, shard)
        return ok

    def _guarded(self, shard: str, op: str, seq: str | None = None) -> None:
        if self.store is None or shard not in self._held:
            return
        row, ok = self.store.run(shard, op, self.options.owner, self._held[shard].counter, seq)
        if ok:
            self._held[shard] = row
        else:
            self._lose(shard)

    def _checkpoint(self, shard: str, seq: str | None) -> None:
        if seq is not None:
            self._guarded(shard, "checkpoint", seq)

    def _lose(self, shard: str) -> None:
        self.lost.add(shard)
        self.owned.discard(shard)
        self._held.pop(shard, None)
        self._deferral.drop(shard)
        self.metrics.record("lease_lost", 1, shard)
        self._signal([shard], "lease_lost")

    def release_all(self) -> None:
        """Write what is pending and give up all leases, the leader's too."""
        for shard in sorted(self.owned):
            self._checkpoint(shard, self._deferral.flush(shard))
            self._guarded(shard, "release")
            self._held.pop(shard, None)
        self.owned.clear()
        if self.store is not None and (row := self.store.get(LEADER_KEY)) and row.owner == self.options.owner:
            self.store.run(LEADER_KEY, "release", self.options.owner, row.counter)
        self.leading = False

    # --- Runs -----------------------------------------------------------------------------------------------------

    def start(self, once: bool = True) -> StreamingQuery:
        writer = self.stream().writeStream.foreachBatch(self._batch).option("checkpointLocation", self.state)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{self.options.poll_interval_ms} milliseconds")
        self._listener = _Listener(self.metrics)
        self.spark.streams.addListener(self._listener)
        self.query = writer.start()
        return self.query

    def run(self, once: bool = True) -> dict[str, str]:
        """Consume and return each shard's last acknowledged sequence number of this run.

        With ``once``, passes are repeated until one delivers nothing: children follow in the pass after their parents'
        ends, and a pass that replays a failed batch ends with it.
        """
        try:
            while True:
                before, query = self._batches, self.start(once)
                try:
                    while not query.awaitTermination(0.2 if once else 1):
                        if self._stopping.is_set():
                            self._finish(query)
                finally:
                    self.spark.streams.removeListener(self._listener)
                if not once or self._stopping.is_set() or self._batches == before:
                    break
            if self._stopping.is_set():
                self._signal(sorted(self.owned), "shutdown_requested")
            return dict(self.checkpoints)
        finally:
            self.release_all()

    def _finish(self, query: StreamingQuery) -> None:
        """Wait for the batch at hand, as long as the options grant it, then stop the query."""
        until = time.monotonic() + self.options.graceful_ms / 1000
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
            time.sleep(0.05)
        query.stop()

    def _signal(self, shards: list[str], name: str) -> None:
        """Call a hook where the processors live: the same key deals a shard to the same task as its records."""
        if shards:
            rows = self.spark.createDataFrame([(s,) for s in shards], "shard_id string").repartition(self.options.max_concurrency or len(shards), "shard_id")
            signal(rows, self.factory, name, self.token).collect()

    def stop(self) -> None:
        """Finish the batch at hand, hand the shards over and stop."""
        self._stopping.set()
