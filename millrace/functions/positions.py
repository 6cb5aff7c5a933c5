"""Column functions on sequence numbers, positions, checkpoints and lease keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schema import HEARTBEAT_PREFIX, IDLE_BASE_MS, IDLE_CAP_MS, LATEST, LEADER_KEY, MAX_FETCH, MIN_FETCH, TRIM_HORIZON


def seq_order(seq: Column) -> Column:
    """A sortable key of a sequence number: numbers of up to any length order by length, then by digits. Never a cast: 39 digits overflow."""
    return F.struct(F.length(seq).alias("n"), seq.alias("s"))


def after(seq: Column, checkpoint: Column) -> Column:
    """Whether a sequence number lies after a checkpoint."""
    return (F.length(seq) > F.length(checkpoint)) | ((F.length(seq) == F.length(checkpoint)) & (seq > checkpoint))


def initial_position(text: Column) -> Column:
    name = F.upper(F.trim(text))
    return F.when(name.isin(TRIM_HORIZON, "TRIM-HORIZON", "TRIMHORIZON"), TRIM_HORIZON).when(name == LATEST, LATEST)


def start_kind(checkpoint: Column) -> Column:
    """TRIM_HORIZON for null, LATEST for its sentinel, else AFTER."""
    return F.when(checkpoint.isNull(), TRIM_HORIZON).when(checkpoint == LATEST, LATEST).otherwise("AFTER")


def start_mode(checkpoint: Column) -> Column:
    """Whether a checkpoint names a start, not a record."""
    return checkpoint.isNull() | (checkpoint == LATEST)


def as_checkpoint(kind: Column, seq: Column) -> Column:
    return F.when(kind == LATEST, LATEST).when(kind == "AFTER", seq)


def seed_checkpoint(position: Column) -> Column:
    """What a lease is created with: null for TRIM_HORIZON."""
    return F.when(position == LATEST, LATEST)


def child_seed(checkpoints: Column) -> Column:
    """A child's seed from its parents' checkpoints: LATEST only if there are parents and all of them are at LATEST."""
    return F.when((F.size(checkpoints) > 0) & F.forall(checkpoints, lambda c: F.coalesce(c == LATEST, F.lit(False))), LATEST)


def lease_key(stream: Column | None, shard: Column) -> Column:
    return shard if stream is None else F.concat_ws(":", stream, shard)


def stream_of(key: Column) -> Column:
    """What stands before the last colon; null without one."""
    return F.when(F.contains(key, F.lit(":")), F.regexp_extract(key, "^(.*):([^:]*)$", 1))


def shard_of(key: Column) -> Column:
    """What stands after the last colon; the whole key without one."""
    return F.substring_index(key, ":", -1)


def heartbeat_key(worker: Column) -> Column:
    return F.concat(F.lit(HEARTBEAT_PREFIX), worker)


def is_heartbeat(key: Column) -> Column:
    return F.startswith(key, F.lit(HEARTBEAT_PREFIX))


def is_pseudo(key: Column) -> Column:
    """Rows of the lease table that are no shards: heartbeats and the leader's."""
    return is_heartbeat(key) | (key == LEADER_KEY)


def fetch_size(n: Column) -> Column:
    return F.greatest(F.lit(MIN_FETCH), F.least(F.lit(MAX_FETCH), n))


def idle_sleep(nth: Column, base: int = IDLE_BASE_MS, cap: int = IDLE_CAP_MS) -> Column:
    """Milliseconds to wait after the nth empty fetch in a row; the exponent is bounded, the cap reached long before."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(nth - 1, F.lit(30))), F.lit(cap)).cast("long")


def lag_ms(now_ms: Column, created_ms: Column) -> Column:
    return F.when(created_ms.isNotNull(), F.greatest(F.lit(0).cast("long"), now_ms - created_ms))
