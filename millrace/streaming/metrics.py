"""What a consumer reports, under fixed names."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# Counters (sums) and gauges (last values), by name and unit.
COUNTERS = {"records_processed": "1", "bytes_processed": "By", "catalog_scans": "1", "shard_end_count": "1", "lease_acquired": "1", "lease_lost": "1"}
GAUGES = {"millis_behind_latest": "ms", "lease_held": "1", "slot_wait_ms": "ms", "max_concurrency": "1", "queue_depth": "1"}
METRICS = tuple(COUNTERS) + tuple(GAUGES)


class MetricsSink:
    """Override what is needed; the default does nothing."""

    def record(self, name: str, value: int, shard: str | None = None) -> None:
        """One value of a metric of ``METRICS``; shard is null for those of the whole consumer."""

    def batch(self, shard: str, records: int, size: int, lag_ms: int | None) -> None: ...

    def shard_ended(self, shard: str) -> None: ...

    def progress(self, batch: int, metrics: dict[str, Any]) -> None: ...


@dataclass
class Totals(MetricsSink):
    """Sums of what was reported, by shard, and each metric's sum or last value."""

    records: dict[str, int] = field(default_factory=dict)
    size: dict[str, int] = field(default_factory=dict)
    lag_ms: dict[str, int | None] = field(default_factory=dict)
    ended: list[str] = field(default_factory=list)
    values: dict[str, int] = field(default_factory=dict)
    by_shard: dict[tuple[str, str], int] = field(default_factory=dict)

    def record(self, name: str, value: int, shard: str | None = None) -> None:
        if name not in METRICS:
            raise ValueError(f"metric {name!r}")
        add = name in COUNTERS
        self.values[name] = value + (self.values.get(name, 0) if add else 0)
        if shard is not None:
            self.by_shard[name, shard] = value + (self.by_shard.get((name, shard), 0) if add else 0)

    def batch(self, shard: str, records: int, size: int, lag_ms: int | None) -> None:
        self.records[shard] = self.records.get(shard, 0) + records
        self.size[shard] = self.size.get(shard, 0) + size
        self.lag_ms[shard] = lag_ms

    def shard_ended(self, shard: str) -> None:
        self.ended.append(shard)
