"""Row shapes of the data model and the options of a consumer."""

from __future__ import annotations

import os
import socket
from collections.abc import Mapping
from dataclasses import dataclass

#: An engine record: one change of one shard, payload opaque.
RECORD = "shard_id string, seq string, data binary"
#: A typed change event; the images are JSON text of attribute values in wire form.
EVENT = "event_name string, sequence_number string, size_bytes bigint, stream_view_type string, keys string, new_image string, old_image string, approx_creation_time_ms bigint"
#: A raw shard of a catalogue, with the page and place at which it was listed, and a node of the lineage graph.
RAW_SHARD = "shard_id string, parent_shard_id string, ending_sequence_number string, page int, pos int"
SHARD = "id string, parents array<string>"
#: A lease row; heartbeat and leader rows share the table.
LEASE = "lease_key string, owner string, counter bigint, checkpoint string, completed boolean, parents array<string>"

# Strings and limits that stored state and configuration share.
LATEST = "LATEST"
TRIM_HORIZON = "TRIM_HORIZON"
HEARTBEAT_PREFIX = "__hb__:"
LEADER_KEY = "__shard_sync_leader__"
CLOSED_BY_SYNC = "__closed_by_shard_sync__"
MIN_FETCH, MAX_FETCH = 1, 1000
POLL_FLOOR_MS, IDLE_BASE_MS, IDLE_CAP_MS = 250, 1000, 5000


@dataclass(frozen=True)
class ConsumerOptions:
    """Settings of a consumer, with the defaults of an unset environment."""

    max_leases: int = 100
    lease_duration_ms: int = 10_000
    poll_interval_ms: int = 1_000
    cycle_interval_ms: int = 1_000
    graceful_ms: int = 5_000
    initial_position: str = TRIM_HORIZON
    #: Shards processed at a time, and milliseconds between checkpoints of a shard; None: no bound, every batch.
    max_concurrency: int | None = None
    checkpoint_interval_ms: int | None = None
    max_records: int = MAX_FETCH
    record_format: str = "native"
    owner: str = ""

    def __post_init__(self) -> None:
        if parse_position(self.initial_position) is None:
            raise ValueError(f"initial position {self.initial_position!r}: TRIM_HORIZON or LATEST")
        if self.record_format not in ("native", "typed_json"):
            raise ValueError(f"record format {self.record_format!r}: native or typed_json")
        object.__setattr__(self, "initial_position", parse_position(self.initial_position))
        object.__setattr__(self, "max_records", max(MIN_FETCH, min(MAX_FETCH, self.max_records)))
        object.__setattr__(self, "max_concurrency", self.max_concurrency or None)
        object.__setattr__(self, "checkpoint_interval_ms", self.checkpoint_interval_ms or None)
        object.__setattr__(self, "owner", self.owner or f"{socket.gethostname()}:{os.getpid()}")

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "MILLRACE_") -> ConsumerOptions:
        """Options from variables named after the fields; unset or empty ones keep their defaults."""
        given = {}
        for name, f in cls.__dataclass_fields__.items():
            raw = env.get(prefix + name.upper(), "").strip()
            if raw:
                given[name] = raw if f.type == "str" else int(raw)
        return cls(**given)


def parse_position(text: str | None) -> str | None:
    """TRIM_HORIZON or LATEST, whatever the case and the separator; None for anything else."""
    name = (text or "").strip().upper()
    return {TRIM_HORIZON: TRIM_HORIZON, "TRIM-HORIZON": TRIM_HORIZON, "TRIMHORIZON": TRIM_HORIZON, LATEST: LATEST}.get(name)
