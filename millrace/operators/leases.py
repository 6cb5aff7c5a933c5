"""Lease balancing, liveness and the lease table's guarded operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.positions import is_pseudo
from millrace.operators.delivery import fold_ordered


def owner_counts(leases: DataFrame) -> DataFrame:
    """(owner, n) of live owners: what they hold that is neither complete nor expired."""
    return leases.where("not completed and not expired and owner is not null").groupBy("owner").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Share:
    """What a worker's fair share follows from."""

    active: int
    workers: int
    target: int
    mine: int

    @property
    def need(self) -> int:
        return max(0, self.target - self.mine)


def fair_share(leases: DataFrame, me: str) -> DataFrame:
    """One row (active, workers, target, mine): live workers include ``me``, the target is rounded up."""
    live = F.col("owner").isNotNull() & ~F.col("expired")
    others = F.count_distinct(F.when(live & (F.col("owner") != me), F.col("owner")))
    found = leases.where("not completed").agg(F.count("*").alias("active"), (others + 1).alias("workers"), F.count_if(live & (F.col("owner") == me)).alias("mine"))
    return found.select("active", "workers", F.expr("(active + workers - 1) div workers").alias("target"), "mine")


def share_of(leases: DataFrame, me: str) -> Share:
    row = fair_share(leases, me).first()
    return Share(row["active"], row["workers"], row["target"], row["mine"])


def leases_to_take(leases: DataFrame, me: str, most: int) -> DataFrame:
    """(lease_key, how) of at most ``most`` leases that ``me`` should try to take.

    Unowned and expired ones come first, by key. If those fall short of the fair share, the worker that holds most
    (the first by name among equals) gives what it holds above the target. The decision's numbers are a few
    aggregates; the picks are top-k by key, so no step sorts the table in one task.
    """
    share = share_of(leases, me)
    need = min(share.need, most) if share.active else 0
    active = leases.where("not completed")
    available = active.where(F.col("owner").isNull() | (F.col("expired") & (F.col("owner") != me)))
    taken = available.orderBy("lease_key").limit(max(0, need)).select("lease_key", F.lit("available").alias("how"))
    if not need:
        return taken
    short = need - taken.count()
    others = owner_counts(active).where(F.col("owner") != me)
    victim = others.orderBy(F.desc("n"), "owner").first() if short > 0 else None
    if victim is None or victim["n"] <= share.target:
        return taken
    held = active.where((F.col("owner") == victim["owner"]) & ~F.col("expired"))
    stolen = held.orderBy("lease_key").limit(min(victim["n"] - share.target, short)).select("lease_key", F.lit("steal").alias("how"))
    return taken.unionByName(stolen)


def liveness(snapshots: DataFrame, duration: int) -> DataFrame:
    """(worker, now_ms, counter, changed_ms, expired) for a log of heartbeat counters.

    A worker's clock restarts when its counter differs from the sighting before; it is expired once the clock is older
    than the lease duration, strictly. The first sighting starts the clock.
    """
    by = Window.partitionBy("worker").orderBy("now_ms")
    before = F.lag("counter").over(by)
    moved = snapshots.withColumn("moved", F.when(before.isNull() | (before != F.col("counter")), F.col("now_ms")))
    clock = moved.withColumn("changed_ms", F.max("moved").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("moved")
    return clock.withColumn("expired", F.col("now_ms") - F.col("changed_ms") > duration)


def with_expiry(leases: DataFrame, clocks: DataFrame, me: str, now_ms: int, duration: int) -> DataFrame:
    """Leases with ``expired`` from their owners' clocks (worker, changed_ms); own and unowned ones never are, nor owners not yet seen."""
    rows = leases.where(~is_pseudo(F.col("lease_key"))).join(clocks.withColumnRenamed("worker", "owner"), "owner", "left")
    stale = F.lit(now_ms) - F.col("changed_ms") > duration
    return rows.withColumn("expired", F.coalesce((F.col("owner") != me) & stale, F.lit(False))).drop("changed_ms")


def takeable(owner: Column, counter: Column, last_seen: Column) -> Column:
    """Whether a lease is free or its counter has not moved since it was last seen."""
    return owner.isNull() | F.coalesce(counter == last_seen, F.lit(False))


def leader_step(owner: Column, counter: Column, expired: Column, me: str) -> Column:
    """renew, create, steal or follow: what a worker does about the leader row. A null counter means that there is none.

    A row without an owner has been released: it is taken like an expired one, on the counter that was seen.
    """
    return F.when(counter.isNull(), "create").when(owner == me, "renew").when(owner.isNull() | expired, "steal").otherwise("follow")


def owned(leases: DataFrame, me: str) -> DataFrame:
    return leases.where((F.col("owner") == me) & ~F.col("completed") & ~is_pseudo(F.col("lease_key")))


def leases_held(leases: DataFrame) -> DataFrame:
    """(owner, held) gauge: leases of each owner that are not complete."""
    return leases.where(F.col("owner").isNotNull() & ~is_pseudo(F.col("lease_key"))).groupBy("owner").agg(F.count_if(~F.col("completed")).alias("held"))


def all_complete(leases: DataFrame) -> DataFrame:
    """One row: whether there is a lease and all are complete."""
    return leases.agg(((F.count("*") > 0) & F.coalesce(F.bool_and("completed"), F.lit(False))).alias("all_complete"))


# --- The lease table's operations -------------------------------------------------------------------------------


@dataclass
class Row:
    """A lease's state; None of it exists before the first write."""

    owner: str | None = None
    counter: int = 0
    checkpoint: str | None = None
    completed: bool = False


def apply_op(row: Row | None, op: str, owner: str | None, counter: int | None, seq: str | None) -> tuple[Row | None, bool]:
    """(row after, whether the guard held). ``counter`` is what the caller saw; a lost guard leaves the row as it was."""
    held = row is not None and row.counter == counter and row.owner == owner
    match op:
        case "create":
            return (Row(checkpoint=seq), True) if row is None else (row, True)
        case "acquire":
            if row is None:
                return Row(owner, 1), True
            return Row(owner, row.counter + 1, row.checkpoint, row.completed), True
        case "claim":
            if row is None or row.counter != counter:
                return row, False
            return Row(owner, row.counter + 1, row.checkpoint, row.completed), True
        case "lead":
            if row is None:
                return (Row(owner, 1), True) if counter is None else (None, False)
            return (Row(owner, row.counter + 1, row.checkpoint, row.completed), True) if counter is not None and row.counter == counter else (row, False)
        case "heartbeat":
            return Row(owner, (row.counter if row else 0) + 1, row.checkpoint if row else None, bool(row and row.completed)), True
        case "renew":
            return (Row(owner, row.counter + 1, row.checkpoint, row.completed), True) if held else (row, False)
        case "checkpoint":
            return (Row(owner, row.counter + 1, seq, row.completed), True) if held else (row, False)
        case "complete":
            return (Row(owner, row.counter, row.checkpoint, True), True) if held else (row, False)
        case "release":
            return (Row(None, row.counter + 1, row.checkpoint, row.completed), True) if held else (row, False)
        case "delete":
            return (None, True) if row is not None and row.completed else (row, False)
    raise ValueError(f"unknown operation {op!r}")


def apply_log(log: DataFrame) -> DataFrame:
    """The log (lease_key, at, op, owner, counter, seq) with what each request made of its lease, in the order of ``at``.

    Each lease is a fold of its own; rows stream through, one state is held at a time.
    """

    def start() -> Callable[[dict], dict]:
        state: dict[str, Row | None] = {"row": None}

        def step(r: dict) -> dict:
            state["row"], ok = apply_op(state["row"], r["op"], r["owner"], r["counter"], r["seq"])
            now = state["row"]
            return {
                "lease_key": r["lease_key"], "at": r["at"], "op": r["op"], "applied": ok, "exists": now is not None, "owner_after": now.owner if now else None,
                "counter_after": now.counter if now else None, "checkpoint_after": now.checkpoint if now else None, "completed_after": now.completed if now else None,
            }

        return step

    shape = "lease_key string, at bigint, op string, applied boolean, exists boolean, owner_after string, counter_after bigint, checkpoint_after string, completed_after boolean"
    return fold_ordered(log.select("lease_key", "at", "op", "owner", "counter", "seq"), "lease_key", ["at"], start, shape)


class LeaseStore:
    """A lease table in SQLite whose guarded writes are transactions: for one host, and for tests.

    On a cluster one Spark driver owns a query and needs no leases; several drivers would put this interface on a
    database that they share.
    """

    def __init__(self, path: str = ":memory:") -> None:
        import sqlite3
        import threading

        # A streaming query's batches run in a thread of their own.
        self.db = sqlite3.connect(path, isolation_level=None, check_same_thread=False)
        self.lock = threading.RLock()
        self.db.execute("CREATE TABLE IF NOT EXISTS leases (lease_key TEXT PRIMARY KEY, owner TEXT, counter INTEGER NOT NULL DEFAULT 0, checkpoint TEXT, completed INTEGER NOT NULL DEFAULT 0, parents TEXT NOT NULL DEFAULT '[]')")

    def get(self, key: str) -> Row | None:
        with self.lock:
            got = self.db.execute("SELECT owner, counter, checkpoint, completed FROM leases WHERE lease_key = ?", (key,)).fetchone()
        return Row(got[0], got[1], got[2], bool(got[3])) if got else None

    def rows(self) -> Iterator[tuple]:
        """All leases as the columns of the lease table, parents as a list."""
        import json

        with self.lock:
            found = self.db.execute("SELECT * FROM leases ORDER BY lease_key").fetchall()
        for key, owner, counter, checkpoint, completed, parents in found:
            yield key, owner, counter, checkpoint, bool(completed), json.loads(parents)

    def run(self, key: str, op: str, owner: str | None = None, counter: int | None = None, seq: str | None = None, parents: list[str] | None = None) -> tuple[Row | None, bool]:
        """Apply one operation under its guard."""
        with self.lock:
            return self._run(key, op, owner, counter, seq, parents)

    def _run(self, key: str, op: str, owner: str | None, counter: int | None, seq: str | None, parents: list[str] | None) -> tuple[Row | None, bool]:
        import json

        self.db.execute("BEGIN IMMEDIATE")
        try:
            before = self.get(key)
            after, ok = apply_op(before, op, owner, counter, seq)
            if after is None and before is not None:
                self.db.execute("DELETE FROM leases WHERE lease_key = ?", (key,))
            elif before is None and after is not None:
                self.db.execute("INSERT INTO leases VALUES (?, ?, ?, ?, ?, ?)", (key, after.owner, after.counter, after.checkpoint, after.completed, json.dumps(parents or [])))
            elif after is not None and after != before:
                self.db.execute("UPDATE leases SET owner = ?, counter = ?, checkpoint = ?, completed = ? WHERE lease_key = ?", (after.owner, after.counter, after.checkpoint, after.completed, key))
            self.db.execute("COMMIT")
        except BaseException:
            self.db.execute("ROLLBACK")
            raise
        return after, ok

    def frame(self, spark) -> DataFrame:
        from millrace.schema import LEASE

        return spark.createDataFrame(list(self.rows()), LEASE)
