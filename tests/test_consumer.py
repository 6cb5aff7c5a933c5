"""A consumer's leases, hooks, records and metrics; sessions, retries and cursors."""

import asyncio
import json
import os
import threading

import pytest

from millrace.operators.delivery import Deferral
from millrace.operators.leases import LeaseStore
from millrace.schema import LEADER_KEY, ConsumerOptions
from millrace.sources.retry import Cursor, LeaseLost, Throttled, Trimmed, classify, with_retry
from millrace.streaming.metrics import METRICS, Totals
from millrace.streaming.session import SessionError, consume, replay
from millrace.streaming.worker import Worker

from .test_operators import SESSION, batch
from .test_streaming import Log, Recorder, said


class Hooked(Recorder):
    def initialize(self, shard):
        self._say("initialize", shard)

    def shutdown_requested(self, shard):
        self._say("shutdown_requested", shard)

    def lease_lost(self, shard):
        self._say("lease_lost", shard)


class Counting(LeaseStore):
    def __init__(self):
        super().__init__()
        self.ops = []

    def run(self, key, op, *args, **kw):
        got = super().run(key, op, *args, **kw)
        self.ops.append((key, op, got[1]))
        return got


@pytest.mark.parametrize(("interval", "writes"), [(None, 3), (60_000, 1)])
def test_checkpoints_are_deferred(spark, tmp_path, interval, writes):
    log, store, clock = Log(tmp_path / "log"), Counting(), iter(range(0, 10**6, 10))
    log.shard("s")
    log.put("s", 101, 102, 103)
    out = str(tmp_path / "said")
    w = Worker(spark, str(log.root), str(tmp_path / "state"), lambda: Hooked(out), ConsumerOptions(owner="me", checkpoint_interval_ms=interval), max_bytes=10, store=store, now_ms=lambda: next(clock))
    assert w.run() == {"s": "103"}
    assert store.ops.count(("s", "checkpoint", True)) == writes
    row = store.get("s")
    assert (row.owner, row.checkpoint, row.completed) == (None, "103", False) and ("s", "release", True) in store.ops
    assert store.get(LEADER_KEY).owner is None


def test_deferral():
    at_once, later = Deferral(0), Deferral(1000)
    assert [at_once.acknowledge("s", str(k), k) for k in range(3)] == ["0", "1", "2"] and at_once.flush("s") is None
    assert [later.acknowledge("s", str(k), 300 * k) for k in range(6)] == [None] * 4 + ["4"] + [None]
    assert later.flush("s") == "5" and later.flush("s") is None
    later.acknowledge("t", "1", 0)
    later.drop("t")
    assert later.flush("t") is None


def test_leader_syncs_completes_and_cleans(spark, tmp_path):
    log, store, totals = Log(tmp_path / "log"), Counting(), Totals()
    log.shard("p")
    log.shard("c", "p")
    log.put("p", 1)
    log.put("c", 2)
    out = str(tmp_path / "said")
    w = Worker(spark, str(log.root), str(tmp_path / "state"), lambda: Hooked(out), ConsumerOptions(owner="me", cycle_interval_ms=1), metrics=totals, store=store)
    assert w.run() == {"p": "1", "c": "2"}
    w.leading = w._lead(w.now_ms())
    w._cycled = 0
    w.cycle()
    # The parent is complete and its child has begun: its lease goes and does not come back.
    assert store.get("p") is None and store.get("c").checkpoint == "2"
    w._cycled = 0
    w.cycle()
    assert store.get("p") is None
    assert set(totals.values) <= set(METRICS) and totals.values["records_processed"] == 2 and totals.values["shard_end_count"] == 1
    assert totals.values["lease_acquired"] == 2 and totals.values["catalog_scans"] >= 2 and totals.values["max_concurrency"] == 0 and "slot_wait_ms" in totals.values


def test_a_lost_lease_stops_its_shard(spark, tmp_path):
    log, store, totals = Log(tmp_path / "log"), Counting(), Totals()
    log.shard("s")
    log.shard("t")
    log.put("s", 1)
    log.put("t", 1)
    out = str(tmp_path / "said")
    store.run("t", "create")
    store.run("t", "claim", "other", 0)
    w = Worker(spark, str(log.root), str(tmp_path / "state"), lambda: Hooked(out), ConsumerOptions(owner="me"), metrics=totals, store=store)
    assert w.run() == {"s": "1"} and w.lost == {"t"} and totals.values["lease_lost"] == 1
    assert ["lease_lost", "t"] in said(out) and store.get("t").owner == "other"
    log.put("t", 2)
    log.put("s", 2)
    assert w.run()["s"] == "2" and ["records", "t", ["2"]] not in said(out)


def test_hand_over_on_stop(spark, tmp_path):
    log = Log(tmp_path / "log")
    log.shard("s")
    log.put("s", 1, 2)
    out = str(tmp_path / "said")
    w = Worker(spark, str(log.root), str(tmp_path / "state"), lambda: Hooked(out), ConsumerOptions(poll_interval_ms=100, owner="me"))
    done = {}
    t = threading.Thread(target=lambda: done.update(w.run(once=False)))
    t.start()
    for _ in range(600):
        if any(x[0] == "records" for x in said(out)):
            break
        t.join(0.1)
    for _ in range(600):
        if w.checkpoints:
            break
        t.join(0.1)
    w.stop()
    t.join(60)
    assert not t.is_alive() and done == {"s": "2"}
    assert said(out)[-1] == ["shutdown_requested", "s"] and not w.owned


EVENT = {"event_name": "INSERT", "sequence_number": "5", "keys": {"id": {"N": "1"}}, "new_image": {"b": {"B": [1, 2]}, "on": {"Bool": True}}, "approx_creation_time_ms": 9_000}


class Typed(Recorder):
    def process_records(self, shard, records):
        self._say("events", shard, [r["event"] and {k: (v.hex() if isinstance(v, bytes) else v) for k, v in r["event"]["new_image"].items()} for r in records])


@pytest.mark.parametrize(("record_format", "want"), [("native", {"b": "0102", "on": True}), ("typed_json", {"b": {"B": "AQI="}, "on": {"BOOL": True}})])
def test_typed_records_and_lag(spark, tmp_path, record_format, want):
    log, totals, out = Log(tmp_path / "log"), Totals(), str(tmp_path / "said")
    log.shard("s")
    with (log.root / "records" / "s.jsonl").open("a") as f:
        f.write(json.dumps({"seq": "5", "data": json.dumps(EVENT)}) + "\n" + json.dumps({"seq": "6", "data": "not an event"}) + "\n")
    w = Worker(spark, str(log.root), str(tmp_path / "state"), lambda: Typed(out), ConsumerOptions(record_format=record_format), metrics=totals, now_ms=lambda: 10_500)
    w.run()
    assert said(out) == [["events", "s", [want, None]]]
    assert totals.lag_ms == {"s": 1_500} and totals.by_shard["millis_behind_latest", "s"] == 1_500


class Slow(Recorder):
    """A coroutine that takes two records at a time."""

    async def process_records(self, shard, records):
        await asyncio.sleep(0)
        self._say("took", [r["seq"] for r in records[:2]])
        return records[:2][-1]["seq"]


def test_coroutines_and_partial_acknowledgement(spark, tmp_path):
    log, out = Log(tmp_path / "log"), str(tmp_path / "said")
    log.shard("s", ended=True)
    log.put("s", 1, 2, 3, 4, 5)
    assert Worker(spark, str(log.root), str(tmp_path / "state"), lambda: Slow(out)).run() == {"s": "5"}
    assert said(out) == [["took", ["1", "2"]], ["took", ["3", "4"]], ["took", ["5"]], ["ended", "s"]]


# --- Sessions


class Seen:
    def __init__(self, deny=()):
        self.log, self.deny = [], deny

    def process_records(self, shard, records):
        self.log.append((shard, [r["seq"] for r in records]))
        return records[-1]["seq"] not in self.deny

    def shard_ended(self, shard):
        self.log.append((shard, "ended"))

    def shutdown_requested(self, shard):
        self.log.append((shard, "shutdown"))

    def lease_lost(self, shard):
        self.log.append((shard, "lost"))


def play(script, **kw):
    """A script's server and a client, joined by two pipes: acknowledgements, the client's result, what its code saw."""
    down, up = os.pipe(), os.pipe()
    user, result = Seen(**kw), {}

    def client():
        with os.fdopen(down[0]) as lines, os.fdopen(up[1], "w") as answers:
            result.update(consume(lines, answers, lambda: user, "me"))

    t = threading.Thread(target=client)
    t.start()
    with os.fdopen(down[1], "w") as lines, os.fdopen(up[0]) as answers:
        try:
            acks = replay(script, lines, answers)
        finally:
            lines.close()
            t.join(20)
    return acks, result, user.log


MANY = [batch("one", 1, 2), {"await_checkpoints": [{"shard": "one", "seq": "2"}]}, batch("one", 3, 4, 5), {"await_checkpoints": [{"shard": "one", "seq": "5"}]}, {"emit": {"type": "shutdown_requested"}}, {"emit": {"type": "lease_lost", "shard": "one"}}, {"emit": {"type": "shutdown"}}]


def test_scripts_are_replayed_and_awaited():
    acks, done, log = play(SESSION)
    assert acks == {"left": ["11"], "right": ["3"], "top": ["40"]} and done == {"left": "11", "right": "3", "top": "40"}
    assert log == [("left", ["7", "8", "11"]), ("left", "ended"), ("right", ["3"]), ("top", ["40"])]
    acks, done, log = play(MANY)
    assert acks == {"one": ["2", "5"]} and log == [("one", ["1", "2"]), ("one", ["3", "4", "5"]), ("one", "shutdown"), ("one", "lost")]
    assert play([{"emit": {"type": "shutdown", "reason": "nothing"}}]) == ({}, {}, [])


def test_a_missing_acknowledgement_is_seen():
    with pytest.raises(SessionError):
        play([batch("s", 1), {"emit": {"type": "shutdown"}}, {"await_checkpoints": [{"shard": "s", "seq": "1"}]}], deny=("1",))


# --- Errors


def test_classes_and_retries():
    assert [classify(e) for e in (LeaseLost("x"), RuntimeError("ConditionalCheckFailedException: no"), Throttled("x"), ValueError("ThrottlingException"), Trimmed("x"), RuntimeError("ExpiredIteratorException"), KeyError("x"))] == ["lost"] * 2 + ["throttled"] * 2 + ["restart"] * 2 + ["other"]
    waits, left = [], [3]

    def op():
        if left[0]:
            left[0] -= 1
            raise Throttled("slow down")
        return "done"

    assert with_retry(op, sleep=waits.append) == "done" and waits == [0.1, 0.2, 0.4]
    left[0], waits[:] = 9, []
    with pytest.raises(Throttled):
        with_retry(op, first_ms=50, sleep=waits.append)
    assert waits == [0.05, 0.1, 0.2, 0.4]
    with pytest.raises(LeaseLost):
        with_retry(lambda: (_ for _ in ()).throw(LeaseLost("x")), sleep=waits.append)
    assert len(waits) == 4


def test_cursor(tmp_path):
    log = Log(tmp_path / "log")
    log.shard("s")
    log.put("s", *range(1, 8))
    c = Cursor(str(log.root), "s")
    assert [r["seq"] for r in c.fetch(3)] == ["1", "2", "3"] and [r["seq"] for r in c.fetch(0)] == ["4"]
    assert [r["seq"] for r in Cursor(str(log.root), "s").seek("AFTER", "6").fetch()] == ["7"]
    assert len(Cursor(str(log.root), "s").seek("AFTER", "99").fetch()) == 7
    tip = Cursor(str(log.root), "s").seek("LATEST")
    assert tip.fetch() == []
    log.put("s", 8)
    assert [r["seq"] for r in tip.fetch()] == ["8"] and tip.fetch() == []
    # The file starts anew and is shorter: the cursor reads it from its start.
    (log.root / "records" / "s.jsonl").write_text("")
    log.put("s", 9)
    assert [r["seq"] for r in tip.fetch()] == ["9"] and tip.restarts == 1
    with pytest.raises(ValueError):
        c.seek("SOMEWHERE")
