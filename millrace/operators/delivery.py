"""Delivery of change records: order, resumption, paging, checkpoints, duplicates and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from millrace.functions.positions import after, lag_ms, seq_order
from millrace.schema import LATEST


def shard_order() -> Window:
    return Window.partitionBy("shard_id").orderBy(F.length("seq"), "seq")


def delivered(records: DataFrame) -> DataFrame:
    """Records dealt so that each shard lies whole in one task, in sequence order: put this directly before a sink."""
    return records.repartition("shard_id").sortWithinPartitions("shard_id", F.length("seq"), "seq")


def with_position(records: DataFrame, name: str = "delivery_pos") -> DataFrame:
    """Records with their place in their shard, from 1."""
    return records.withColumn(name, F.row_number().over(shard_order()))


def resumed(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Records after their shard's checkpoint (shard_id, checkpoint).

    A null or missing checkpoint starts at the beginning, and so does a token that the shard does not hold; a token that
    it holds delivers what follows. LATEST delivers nothing of what is there.
    """
    held = checkpoints.select("shard_id", "checkpoint")
    known = records.join(held, "shard_id").where(F.col("seq") == F.col("checkpoint")).select("shard_id", F.lit(True).alias("known")).distinct()
    rows = records.join(held, "shard_id", "left").join(known, "shard_id", "left")
    cp = F.col("checkpoint")
    keep = cp.isNull() | (F.coalesce(cp != LATEST, F.lit(True)) & (F.col("known").isNull() | after(F.col("seq"), cp)))
    return rows.where(keep).drop("checkpoint", "known")


def resumed_in_order(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """As ``resumed`` where tokens are known to be of the shard: a filter by order, one join."""
    cp = F.col("checkpoint")
    rows = records.join(checkpoints.select("shard_id", "checkpoint"), "shard_id", "left")
    return rows.where(cp.isNull() | (F.coalesce(cp != LATEST, F.lit(True)) & after(F.col("seq"), cp))).drop("checkpoint")


def paged(records: DataFrame, size: int) -> DataFrame:
    """Records with the number of the fetch, from 1, that holds them."""
    from millrace.schema import MAX_FETCH, MIN_FETCH

    size = max(MIN_FETCH, min(MAX_FETCH, size))
    return with_position(records, "place").withColumn("page", F.expr(f"(place + {size - 1}) div {size}")).drop("place")


def last_of_batch() -> Column:
    """The sequence number of the last record in order: what is acknowledged."""
    return F.max_by("seq", seq_order(F.col("seq")))


def shard_metrics(records: DataFrame, now_ms: Column) -> DataFrame:
    """(shard_id, records, bytes, checkpoint, lag_ms): the lag is that of the last record in order that has a creation time."""
    last = F.max_by("created_ms", F.when(F.col("created_ms").isNotNull(), seq_order(F.col("seq"))))
    found = records.groupBy("shard_id").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), last_of_batch().alias("checkpoint"), last.alias("last_ms"))
    return found.select("shard_id", "records", "bytes", "checkpoint", lag_ms(now_ms, F.col("last_ms")).alias("lag_ms"))


def order_violations(observed: DataFrame, key: str = "pk", value: str = "sk", arrival: str = "arrival") -> DataFrame:
    """First observations whose value does not exceed all that their key showed before; repeats of a value are no violation."""
    first = observed.groupBy(key, value).agg(F.min(arrival).alias(arrival))
    before = F.max(value).over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("highest", before).where(F.col(value) < F.col("highest"))


def duplicates(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were delivered more than once, and how many deliveries are too many."""
    return observed.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def deduplicated(records: DataFrame) -> DataFrame:
    """One row per shard and sequence number; at-least-once delivery repeats rows as they were."""
    return records.dropDuplicates(["shard_id", "seq"])


def missing(written: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """What was written and never observed."""
    return written.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def idle_schedule(polls: DataFrame, base: int = 1000, cap: int = 5000, floor: int = 250) -> DataFrame:
    """Polls (shard_id, poll, got) with the milliseconds to wait after each: the floor after data, else doubling up to the cap."""
    by = Window.partitionBy("shard_id").orderBy("poll")
    island = F.sum(F.col("got").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.partitionBy("shard_id", "island", "got").orderBy("poll"))
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("nth") - 1, F.lit(30))), F.lit(cap))
    return polls.withColumn("island", island).withColumn("nth", nth).withColumn("sleep_ms", F.when(F.col("got"), floor).otherwise(wait).cast("long")).drop("island", "nth")


def next_due(schedule: DataFrame) -> DataFrame:
    """(shard_id, due_at): the earliest time at which a shard is to be polled again."""
    return schedule.groupBy("shard_id").agg(F.min("due_at").alias("due_at"))


def fold_ordered(rows: DataFrame, key: str, order: list, start: Callable[[], Callable[[dict], dict | list | None]], shape: str, finish: bool = False) -> DataFrame:
    """Fold each key's rows in order: ``start`` gives a step that maps a row to a row, several or none.

    Keys are dealt to tasks and sorted there; rows stream through, so memory holds one state and one batch, however
    many rows a key has. With ``finish`` the step is called with None after a key's last row.
    """
    schema = StructType.fromDDL(shape)
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None

        def results(got) -> list[dict]:
            return [] if got is None else got if isinstance(got, list) else [got]

        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if step is None or row[key] != now:
                    if step is not None and finish:
                        out += results(step(None))
                    now, step = row[key], start()
                out += results(step(row))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if step is not None and finish:
            yield pa.RecordBatch.from_pylist(results(step(None)), schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[kind]


class Deferral:
    """When acknowledgements of shards are written: at once without an interval, else the last one of each interval.

    A shard's first acknowledgement starts its clock; one that comes at least an interval after the clock is written
    and restarts it. What is pending is flushed at a shard's end and when its lease is given up.
    """

    def __init__(self, interval_ms: int) -> None:
        self.interval_ms = interval_ms
        self.clock: dict[str, int] = {}
        self.pending: dict[str, str] = {}

    def acknowledge(self, shard: str, seq: str, at_ms: int) -> str | None:
        """What is to be written now."""
        started = self.clock.setdefault(shard, at_ms)
        if self.interval_ms <= 0 or at_ms - started >= self.interval_ms:
            self.clock[shard] = at_ms
            self.pending.pop(shard, None)
            return seq
        self.pending[shard] = seq
        return None

    def flush(self, shard: str) -> str | None:
        """What is still to be written of a shard."""
        return self.pending.pop(shard, None)

    def drop(self, shard: str) -> None:
        """Forget a shard that is another worker's."""
        self.pending.pop(shard, None)
        self.clock.pop(shard, None)


def deferred_writes(acks: DataFrame, interval_ms: int) -> DataFrame:
    """(shard_id, at_ms, seq, forced): checkpoints that are written when acknowledgements (shard_id, at_ms, seq) are deferred.

    The first acknowledgement starts the clock; one that comes at least an interval after the clock is written and
    restarts it; what is pending at the shard's end is flushed.
    """

    def start() -> Callable[[dict | None], dict | None]:
        deferral, last = Deferral(interval_ms), {}

        def step(row: dict | None) -> dict | None:
            if row is None:
                return last | {"forced": True} if deferral.flush(last["shard_id"]) is not None else None
            last.update(row)
            return row | {"forced": False} if deferral.acknowledge(row["shard_id"], row["seq"], row["at_ms"]) is not None else None

        return step

    return fold_ordered(acks.select("shard_id", "at_ms", "seq"), "shard_id", ["at_ms"], start, "shard_id string, at_ms bigint, seq string, forced boolean", finish=True)
