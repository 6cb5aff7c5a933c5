"""A Spark data source over a sharded change log.

A log is a folder that all machines see: ``catalog.jsonl`` lists shards
(shard_id, parent_shard_id or parents, ended) and ``records/<shard_id>.jsonl``
holds a shard's records, one JSON object with ``seq`` and ``data`` a line, only
ever appended to. Offsets are bytes, so that finding the tip reads no record.
The folder may be on any file system that pyarrow opens by its URI.

Each shard is one partition, so that a stream has as many tasks as open shards.
A child's records are held back until its parents have ended in an earlier
batch, which keeps parents before children whatever tasks run where. The end of
a shard is a row of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from millrace.schema import LATEST, parse_position

SCHEMA = "component string, generation int, shard_id string, seq string, data string, shard_end boolean"
#: Bytes that a line is looked for at a time where a batch's share of a shard ends, and that are read at a time.
BLOCK = 1 << 16
READ = 1 << 20


class Folder:
    """Files below a path or URI."""

    def __init__(self, root: str) -> None:
        if "://" in root or root.startswith("file:"):
            self.fs, self.root = pafs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
        else:
            self.fs, self.root = pafs.LocalFileSystem(), root
        self.root = self.root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def size(self, name: str) -> int:
        return self.fs.get_file_info(self.path(name)).size or 0

    def read(self, name: str, start: int, end: int) -> bytes:
        if end <= start:
            return b""
        with self.fs.open_input_file(self.path(name)) as f:
            f.seek(start)
            return f.read(end - start)

    def lines(self, name: str, start: int, end: int) -> Iterator[bytes]:
        """The lines from ``start`` up to ``end``, which is the end of a line; a block at a time."""
        rest = b""
        with self.fs.open_input_file(self.path(name)) as f:
            f.seek(start)
            at = start
            while at < end:
                block = f.read(min(READ, end - at))
                if not block:
                    break
                at += len(block)
                *whole, rest = (rest + block).split(b"\n")
                yield from whole
        if rest:
            yield rest

    def replace(self, name: str, parts: Iterator[bytes], attempt: str) -> None:
        """Write a file whole: under another name, then renamed, so that a repeated attempt leaves one result."""
        target = self.path(name)
        self.fs.create_dir(target.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(f"{target}.{attempt}") as f:
            for part in parts:
                f.write(part)
        self.fs.move(f"{target}.{attempt}", target)


def records_file(shard: str) -> str:
    return f"records/{quote(shard, safe='')}.jsonl"


class Catalog:
    """The lineage of a log's shards, read at one moment."""

    def __init__(self, root: str) -> None:
        self.folder = Folder(root)
        self.parents: dict[str, list[str]] = {}
        self.ended: set[str] = set()
        rows = [json.loads(x) for x in self.folder.read("catalog.jsonl", 0, self.folder.size("catalog.jsonl")).splitlines() if x.strip()]
        for r in rows:
            # The first row of a shard names its parents; any may say that it has ended.
            given = r.get("parents") or [p for p in [r.get("parent_shard_id")] if p]
            self.parents.setdefault(r["shard_id"], given)
            if r.get("ended"):
                self.ended.add(r["shard_id"])
        self.parents = {s: [p for p in ps if p in self.parents] for s, ps in self.parents.items()}
        # A shard with children takes no more records.
        self.ended |= {p for ps in self.parents.values() for p in ps}
        self.generation: dict[str, int] = {}
        for s in self.parents:
            self._depth(s)
        self.component: dict[str, str] = {}
        for s in sorted(self.parents, key=lambda s: (self.generation[s], s)):
            own = sorted({self.component[p] for p in self.parents[s]}) or [s]
            for k in own[1:]:
                for t in [t for t, c in self.component.items() if c == k]:
                    self.component[t] = own[0]
            self.component[s] = own[0]

    def _depth(self, shard: str) -> None:
        path = [shard]
        while path:
            s = path[-1]
            todo = [p for p in self.parents[s] if p not in self.generation]
            if any(p in path for p in todo):
                raise ValueError(f"shard {s!r} is its own ancestor")
            if todo:
                path.append(todo[0])
            else:
                self.generation[s] = 1 + max((self.generation[p] for p in self.parents[s]), default=-1)
                path.pop()

    def size(self, shard: str) -> int:
        return self.folder.size(records_file(shard))

    def whole(self, shard: str, start: int, end: int) -> int:
        """The end of the last whole line up to ``end``, or of the first one after it if that is longer."""
        name, size = records_file(shard), self.size(shard)
        end = min(end, size)
        at = end
        while at > start:
            low = max(start, at - BLOCK)
            k = self.folder.read(name, low, at).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
        at = max(start, end)
        while start < end and at < size:
            k = self.folder.read(name, at, min(at + BLOCK, size)).find(b"\n")
            if k >= 0:
                return at + k + 1
            at += BLOCK
        return start


class Share(InputPartition):
    """What one task reads: a shard's bytes from ``start`` to ``end``, and whether its end follows."""

    def __init__(self, root: str, component: str = "", shard: str = "", generation: int = 0, start: int = 0, end: int = 0, last: bool = False) -> None:
        super().__init__(shard)
        self.root, self.component, self.shard, self.generation, self.start, self.end, self.last = root, component, shard, generation, start, end, last


def read_share(share: Share) -> Iterator[tuple]:
    if share.end > share.start:
        for line in Folder(share.root).lines(records_file(share.shard), share.start, share.end):
            record = json.loads(line)
            # Records without a payload or a number are no deliveries.
            if record.get("seq") and record.get("data") is not None:
                data = record["data"]
                yield share.component, share.generation, share.shard, record["seq"], data if isinstance(data, str) else json.dumps(data), False
    if share.last:
        yield share.component, share.generation, share.shard, None, None, True


class ShardLogStreamReader(DataSourceStreamReader):
    """Offsets: shard to [bytes, ended]. They never go back, whatever the folder shows.

    One instance serves a query's whole run; where it stands is known from the last end that ``partitions`` got.
    """

    def __init__(self, root: str, position: str | None, most: int | None, shards: int | None = None) -> None:
        self.root, self.most, self.shards = root, most, shards
        self.seen: dict[str, list] = {}
        self.first: dict[str, list] | None = None
        if position == LATEST:
            # The tip is taken once: the initial offset must not be later than the latest one.
            catalog = Catalog(root)
            self.first = {s: [catalog.whole(s, 0, catalog.size(s)), False] for s in catalog.parents}

    def initialOffset(self) -> dict:
        return {"shards": self.first or {}}

    def _floor(self) -> dict[str, list]:
        return {**(self.first or {}), **self.seen}

    def latestOffset(self) -> dict:
        catalog, floor, out, open_now = Catalog(self.root), self._floor(), {}, 0
        # Shards that have begun come first, so that a bound on their number lets each of them end.
        for s in sorted(catalog.parents, key=lambda s: (not floor.get(s, [0, False])[0], catalog.generation[s], s)):
            at, ended = floor.get(s, [0, False])
            # A child waits until its parents' ends have been delivered by an earlier batch.
            if not ended and all(floor.get(p, [0, False])[1] for p in catalog.parents[s]) and (self.shards is None or open_now < self.shards):
                open_now += 1
                size = catalog.size(s)
                at = max(at, catalog.whole(s, at, min(size, at + self.most) if self.most else size))
                ended = s in catalog.ended and at >= size
            out[s] = [at, ended]
        return {"shards": {**floor, **out}}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, b = start["shards"], end["shards"]
        self.seen = {s: max(b[s], self.seen.get(s, [0, False])) for s in b}
        if a == b:
            return [Share(self.root)]
        catalog, shares = Catalog(self.root), []
        for s in sorted(b):
            x, y = a.get(s, [0, False]), b[s]
            if y[0] > x[0] or (y[1] and not x[1]):
                shares.append(Share(self.root, catalog.component.get(s, s), s, catalog.generation.get(s, 0), x[0], max(x[0], y[0]), bool(y[1] and not x[1])))
        return shares or [Share(self.root)]

    def read(self, partition: Share) -> Iterator[tuple]:
        return read_share(partition)

    def commit(self, end: dict) -> None:
        pass


class ShardLogReader(DataSourceReader):
    """All that is there now; a filter on shard_id leaves the other shards' files unread."""

    def __init__(self, root: str) -> None:
        self.root, self.only = root, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("shard_id",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        catalog = Catalog(self.root)
        wanted = [s for s in sorted(catalog.parents) if self.only is None or s == self.only]
        return [Share(self.root, catalog.component[s], s, catalog.generation[s], 0, catalog.whole(s, 0, catalog.size(s)), s in catalog.ended) for s in wanted] or [Share(self.root)]

    def read(self, partition: Share) -> Iterator[tuple]:
        return read_share(partition)


class ShardLog(DataSource):
    """Format ``shardlog``. Options: path, initialPosition, maxBytesPerShard and, for shards read at a time, maxShards."""

    @classmethod
    def name(cls) -> str:
        return "shardlog"

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        if not self.options.get("path"):
            raise ValueError("option path: the folder of the log")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:
        return ShardLogReader(self._root())

    def streamReader(self, schema) -> DataSourceStreamReader:
        given = self.options.get("initialPosition", "TRIM_HORIZON")
        position = parse_position(given)
        if position is None:
            raise ValueError(f"option initialPosition: {given!r}")
        most = int(self.options.get("maxBytesPerShard", 0)) or None
        return ShardLogStreamReader(self._root(), position, most, int(self.options.get("maxShards", 0)) or None)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with the filter pushdown that its batch reader relies on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardLog)


def write_log(records: DataFrame, shards: DataFrame, path: str) -> None:
    """Append records (shard_id, seq, data) and list shards (id, parents, ended) in a log.

    Each shard is written by one task, in order: what it held when the job began and the new lines, as a file that takes
    the old one's place. A task that runs again writes the same.
    """
    folder = Folder(path)
    held = {i.base_name: i.size for i in folder.fs.get_file_info(pafs.FileSelector(folder.path("records"), allow_not_found=True)) if i.base_name.endswith(".jsonl")}

    def write(rows: Iterator) -> None:
        into, attempt, now, lines = Folder(path), f"attempt-{TaskContext.get().taskAttemptId()}", None, []

        def flush() -> None:
            if now is not None:
                name = records_file(now)
                old = into.read(name, 0, held.get(name.removeprefix("records/"), 0))
                into.replace(name, iter([old, *lines]), attempt)

        for r in rows:
            if r["shard_id"] != now:
                flush()
                now, lines = r["shard_id"], []
            lines.append((json.dumps({"seq": r["seq"], "data": r["data"]}) + "\n").encode())
        flush()

    records.select("shard_id", "seq", F.col("data").cast("string").alias("data")).repartition("shard_id").sortWithinPartitions("shard_id", F.length("seq"), "seq").foreachPartition(write)
    listed = folder.read("catalog.jsonl", 0, folder.size("catalog.jsonl"))
    rows = ((json.dumps({"shard_id": r["id"], "parents": r["parents"], "ended": r["ended"]}) + "\n").encode() for r in shards.select("id", "parents", "ended").orderBy("id").toLocalIterator())
    folder.replace("catalog.jsonl", iter([listed, *rows]), "new")
