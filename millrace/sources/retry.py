"""Classes of source errors, retries, and a cursor over one shard that heals itself."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import TypeVar

from millrace.schema import LATEST, MAX_FETCH, MIN_FETCH, TRIM_HORIZON
from millrace.sources.shardlog import Folder, records_file

T = TypeVar("T")

# What a service's or a store's error says of itself.
LOST = ("ConditionalCheckFailedException",)
THROTTLED = ("ProvisionedThroughputExceededException", "ThrottlingException", "RequestLimitExceeded", "LimitExceededException")
RESTART = ("TrimmedDataAccessException", "ExpiredIteratorException", "ResourceNotFoundException")


class LeaseLost(RuntimeError):
    """Another worker holds the lease."""


class Throttled(RuntimeError):
    """The service asks for patience."""


class Trimmed(RuntimeError):
    """What the position points to is gone: the shard is read again from what is left of it."""


def classify(error: BaseException) -> str:
    """lost, throttled, restart or other: by class, else by the names that the message holds."""
    kinds = ((LeaseLost, LOST, "lost"), (Throttled, THROTTLED, "throttled"), (Trimmed, RESTART, "restart"))
    for cls, names, kind in kinds:
        if isinstance(error, cls) or any(n in f"{type(error).__name__}: {error}" for n in names):
            return kind
    return "other"


def with_retry(op: Callable[[], T], first_ms: int = 100, cap_ms: int = 800, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> T:
    """Run ``op``; only throttling is tried again, after waits that double up to the cap. All else is raised at once."""
    wait = first_ms
    for left in reversed(range(attempts)):
        try:
            return op()
        except Exception as e:
            if not left or classify(e) != "throttled":
                raise
            sleep(wait / 1000)
            wait = min(2 * wait, cap_ms)
    raise AssertionError


class Cursor:
    """Fetches of one shard of a log, a bounded number of records each.

    The cursor keeps its place between fetches, so that a fetch looks for nothing. Where the place is gone (the file
    has become shorter, or was taken away) the shard is read from its start again; records come at least once.
    """

    def __init__(self, root: str, shard: str, sleep: Callable[[float], None] = time.sleep) -> None:
        self.folder, self.shard, self.sleep = Folder(root), shard, sleep
        self.at, self.rest, self.restarts = 0, b"", 0

    def seek(self, position: str, seq: str | None = None) -> Cursor:
        """TRIM_HORIZON, LATEST, or AFTER a sequence number; an unknown number starts at the horizon."""
        self.at = 0
        if position == LATEST:
            self.at = self._size()
        elif position == "AFTER" and seq is not None:
            while page := self._page(1000):
                for end, record in page:
                    self.at = end
                    if record.get("seq") == seq:
                        return self
            self.at = 0
        elif position not in (TRIM_HORIZON, "AFTER"):
            raise ValueError(f"position {position!r}")
        return self

    def _size(self) -> int:
        return self.folder.size(records_file(self.shard))

    def _page(self, most: int) -> list[tuple[int, dict]]:
        """Up to ``most`` whole lines from the cursor on, as (place after it, record)."""
        size = self._size()
        if size < self.at:
            raise Trimmed(self.shard)
        found, at = [], self.at
        raw = self.folder.lines(records_file(self.shard), at, size) if size > at else ()
        for line in raw:
            at += len(line) + 1
            if at > size or len(found) == most:
                break
            found.append((at, json.loads(line)))
        return found

    def fetch(self, limit: int = 1000) -> list[dict]:
        """The next records (seq, data), none if there are none yet; those without a number or a payload are passed over."""
        limit, out = max(MIN_FETCH, min(MAX_FETCH, limit)), []
        while len(out) < limit:
            try:
                page = with_retry(lambda: self._page(limit - len(out)), sleep=self.sleep)
            except Exception as e:
                if classify(e) != "restart":
                    raise
                self.at, self.restarts = 0, self.restarts + 1
                continue
            if not page:
                break
            self.at = page[-1][0]
            out += [r for _, r in page if r.get("seq") and r.get("data") is not None]
        return out
