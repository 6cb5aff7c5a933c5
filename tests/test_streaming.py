import json
from pathlib import Path

import pytest

from millrace.schema import ConsumerOptions
from millrace.sources.shardlog import Catalog, ShardLogStreamReader, register
from millrace.streaming.worker import Totals, Worker


class Log:
    def __init__(self, root):
        self.root = Path(root)
        (self.root / "records").mkdir(parents=True)

    def shard(self, shard_id, *parents, ended=False):
        with (self.root / "catalog.jsonl").open("a") as f:
            f.write(json.dumps({"shard_id": shard_id, "parents": list(parents), "ended": ended}) + "\n")

    def put(self, shard_id, *seqs):
        with (self.root / "records" / f"{shard_id}.jsonl").open("a") as f:
            for s in seqs:
                f.write(json.dumps({"seq": str(s), "data": f"d{s}"}) + "\n")


class Recorder:
    """Writes what it sees to a file: processors run in Python workers."""

    def __init__(self, out, fail_on=None, deny=None):
        self.out, self.fail_on, self.deny = out, fail_on, deny

    def _say(self, *what):
        with open(self.out, "a") as f:
            f.write(json.dumps(what) + "\n")

    def process_records(self, shard, records):
        self._say("records", shard, [r["seq"] for r in records])
        if self.fail_on and any(r["seq"] == self.fail_on for r in records):
            raise RuntimeError("sink failed")
        return not (self.deny and any(r["seq"] == self.deny for r in records))

    def shard_ended(self, shard):
        self._say("ended", shard)


def said(out):
    return [json.loads(x) for x in Path(out).read_text().splitlines()] if Path(out).exists() else []


def worker(spark, log, tmp, options=None, metrics=None, max_bytes=None, **kw):
    out = str(tmp / "said")
    return Worker(spark, str(log.root), str(tmp / "state"), lambda: Recorder(out, **kw), options, metrics, max_bytes), out


def test_parent_before_child_and_ends(spark, tmp_path):
    log = Log(tmp_path / "log")
    log.shard("c", "p")
    log.shard("p")
    log.shard("e", "p", ended=True)
    log.put("c", 3, 4)
    log.put("p", 1, 2, 10)
    totals = Totals()
    w, out = worker(spark, log, tmp_path, metrics=totals)
    assert w.run() == {"p": "10", "c": "4"}
    order = said(out)
    assert order.index(["records", "p", ["1", "2", "10"]]) < order.index(["ended", "p"]) < order.index(["records", "c", ["3", "4"]])
    assert ["ended", "e"] in order and ["ended", "c"] not in order
    assert totals.records == {"p": 3, "c": 2} and sorted(totals.ended) == ["e", "p"]
    # What arrives later follows; nothing comes twice.
    log.put("c", 5)
    w2, _ = worker(spark, log, tmp_path)
    assert w2.run() == {"c": "5"}
    assert [x for x in said(out) if x[0] == "records"][-1] == ["records", "c", ["5"]]


def test_merge_waits_for_both_parents(spark, tmp_path):
    log = Log(tmp_path / "log")
    for s in ("a", "b"):
        log.shard(s)
    log.shard("m", "a", "b")
    log.put("a", 1, 2)
    log.put("b", 3, 4)
    log.put("m", 5)
    w, out = worker(spark, log, tmp_path)
    w.run()
    order = [x for x in said(out)]
    assert order[-1] == ["records", "m", ["5"]] and order.index(["ended", "a"]) < len(order) - 1 > order.index(["ended", "b"])


@pytest.mark.parametrize("kw", [{"fail_on": "2"}, {"deny": "2"}])
def test_a_failed_batch_comes_again(spark, tmp_path, kw):
    log = Log(tmp_path / "log")
    log.shard("s")
    log.put("s", 1, 2, 3)
    w, out = worker(spark, log, tmp_path, **kw)
    with pytest.raises(Exception):
        w.run()
    assert w.checkpoints == {}
    log.put("s", 4)
    w2, _ = worker(spark, log, tmp_path)
    assert w2.run() == {"s": "4"}
    seen = [x[2] for x in said(out)]
    assert seen[0] == ["1", "2", "3"] and [s for part in seen[1:] for s in part][-4:] == ["1", "2", "3", "4"]


def test_latest_skips_what_is_there(spark, tmp_path):
    log = Log(tmp_path / "log")
    log.shard("s")
    log.put("s", 1, 2)
    w, out = worker(spark, log, tmp_path, ConsumerOptions(initial_position="latest"))
    w.run()
    log.put("s", 3)
    w, _ = worker(spark, log, tmp_path, ConsumerOptions(initial_position="latest"))
    w.run()
    assert [x for x in said(out) if x[0] == "records"] == [["records", "s", ["3"]]]


def test_bounds(spark, tmp_path):
    log = Log(tmp_path / "log")
    for k in range(5):
        log.shard(f"s{k}", ended=True)
        log.put(f"s{k}", *range(1, 8))
    w, out = worker(spark, log, tmp_path, ConsumerOptions(max_records=3, max_concurrency=2))
    assert w.run() == {f"s{k}": "7" for k in range(5)}
    for k in range(5):
        assert [x[2] for x in said(out) if x[:2] == ["records", f"s{k}"]] == [["1", "2", "3"], ["4", "5", "6"], ["7"]]


def test_offsets_never_go_back(tmp_path):
    log = Log(tmp_path / "log")
    log.shard("s")
    log.put("s", 1, 2)
    reader = ShardLogStreamReader(str(log.root), None, None)
    end = reader.latestOffset()
    reader.partitions(reader.initialOffset(), end)
    (log.root / "records" / "s.jsonl").write_text("")
    assert reader.latestOffset() == end
    fresh = ShardLogStreamReader(str(log.root), None, None)
    fresh.partitions(end, end)
    assert fresh.latestOffset() == end


def test_byte_limit_and_partial_lines(tmp_path):
    log = Log(tmp_path / "log")
    log.shard("s")
    log.put("s", *range(100, 120))
    with (log.root / "records" / "s.jsonl").open("a") as f:
        f.write('{"seq": "half')
    reader = ShardLogStreamReader(str(log.root), None, 100)
    got, start = [], reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        got.append([r[3] for p in parts for r in reader.read(p)])
        start = end
    assert [s for part in got for s in part] == [str(k) for k in range(100, 120)] and max(map(len, got)) <= 4


def test_catalog(tmp_path):
    log = Log(tmp_path / "log")
    log.shard("x", "gone")
    log.shard("y", "x")
    log.shard("z", "y", "x")
    log.shard("x")
    c = Catalog(str(log.root))
    assert c.parents == {"x": [], "y": ["x"], "z": ["y", "x"]} and c.generation == {"x": 0, "y": 1, "z": 2} and set(c.component.values()) == {"x"}
    log.shard("p", "q")
    log.shard("q", "p")
    with pytest.raises(ValueError):
        Catalog(str(log.root))


def test_batch_read_with_filter(spark, tmp_path):
    log = Log(tmp_path / "log")
    log.shard("a")
    log.shard("b", "a")
    log.put("a", 1)
    log.put("b", 2)
    register(spark)
    df = spark.read.format("shardlog").load(str(log.root))
    assert sorted((r["shard_id"], r["seq"]) for r in df.where("not shard_end").collect()) == [("a", "1"), ("b", "2")]
    assert [r["seq"] for r in df.where("shard_id = 'b'").collect()] == ["2"]
