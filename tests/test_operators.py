"""Scenarios of the operators as small tables."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import codec
from millrace.functions import positions as pos
from millrace.operators import delivery, leases, lineage
from millrace.schema import CLOSED_BY_SYNC, RAW_SHARD, SHARD, ConsumerOptions
from millrace.sources import protocol

LEASE_VIEW = "lease_key string, owner string, expired boolean, completed boolean"


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


# --- Lineage


def raw(spark, *rows):
    return spark.createDataFrame(rows, RAW_SHARD)


def graph(spark, **parents):
    return spark.createDataFrame([(k, list(v)) for k, v in parents.items()], SHARD)


def done(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_graph_keeps_the_first_listing_and_drops_trimmed_parents(spark):
    pages = raw(spark, ("a", None, None, 0, 0), ("b", "a", None, 0, 1), ("b", "x", None, 1, 0), ("c", "b", None, 1, 1), ("z", "gone", None, 1, 2), ("", None, None, 1, 3))
    assert {r["id"]: r["parents"] for r in lineage.shard_graph(pages).collect()} == {"a": [], "b": ["a"], "c": ["b"], "z": []}


def test_merge_children(spark):
    got = lineage.merge_children(graph(spark, p=[]), raw(spark, ("p", None, None, 0, 0), ("c1", "p", None, 0, 1), ("c2", "c1", None, 0, 2), ("c3", "gone", None, 0, 3)))
    assert {r["id"]: r["parents"] for r in got.collect()} == {"p": [], "c1": ["p"], "c2": ["c1"], "c3": []}


def test_close_open_parents(spark):
    rows = raw(spark, ("p", None, None, 0, 0), ("q", None, "9", 0, 1), ("c", "p", None, 0, 2), ("d", "q", None, 0, 3))
    got = {r["shard_id"]: r["ending_sequence_number"] for r in lineage.close_open_parents(rows).collect()}
    assert got == {"p": CLOSED_BY_SYNC, "q": "9", "c": None, "d": None}


def test_eligibility(spark):
    shards = graph(spark, a=[], b=[], m=["a", "b"], o=["gone"])
    assert ids(lineage.eligible(shards, done(spark))) == ["a", "b"]
    assert ids(lineage.eligible(shards, done(spark, "a"))) == ["b"]
    assert ids(lineage.eligible(shards, done(spark, "a", "b"))) == ["m"]
    assert ids(lineage.eligible(shards, done(spark, "a", "b"), missing_blocks=False)) == ["m", "o"]


@pytest.mark.parametrize(
    ("state", "want"),
    [
        ([("p", True, False), ("c", False, True)], ["p"]),
        ([("p", True, False), ("c", False, False)], []),
        ([("p", True, False)], []),
        ([("p", False, True), ("c", True, True)], []),
        ([("p", True, True), ("c", True, True)], ["p"]),
    ],
)
def test_cleanup(spark, state, want):
    table = spark.createDataFrame(state, "id string, completed boolean, processing boolean")
    assert ids(lineage.safe_to_delete(graph(spark, p=[], c=["p"]), table)) == want


def test_cleanup_of_a_merge(spark):
    table = spark.createDataFrame([("a", True, True), ("b", True, True), ("m", False, True)], "id string, completed boolean, processing boolean")
    assert ids(lineage.safe_to_delete(graph(spark, a=[], b=[], m=["a", "b"]), table)) == ["a", "b"]


@pytest.mark.parametrize(("checkpoints", "want"), [([], None), (["5"], None), ([None], None), (["LATEST"], "LATEST"), (["LATEST", "LATEST"], "LATEST"), (["LATEST", "5"], None), (["LATEST", None], None)])
def test_child_seed(spark, checkpoints, want):
    assert spark.createDataFrame([(checkpoints,)], "c array<string>").select(pos.child_seed(F.col("c"))).first()[0] == want


def test_generations_of_many_paths_and_long_chains(spark):
    """Forty cycles of a split and a merge have 2 ** 40 paths."""
    nodes = {"r0": []}
    for k in range(40):
        nodes |= {f"a{k}": [f"r{k}"], f"b{k}": [f"r{k}"], f"r{k + 1}": [f"a{k}", f"b{k}"]}
    got = dict(map(tuple, lineage.generations(graph(spark, **nodes)).collect()))
    assert got["r40"] == 80 and got["a39"] == 79 and len(got) == 121
    chain = {"c0": []} | {f"c{k}": [f"c{k - 1}"] for k in range(1, 1000)}
    assert dict(map(tuple, lineage.generations(graph(spark, **chain)).collect())) == {f"c{k}": k for k in range(1000)}
    with pytest.raises(ValueError):
        lineage.generations(graph(spark, x=["y"], y=["x"]))


def test_generations_level_by_level(spark):
    """The way of large graphs gives the same."""
    nodes = dict(a=[], b=["a"], c=["b"], m=["a", "c"], o=["gone"], z=["m", "a"], w=[])
    small = sorted(map(tuple, lineage.generations(graph(spark, **nodes)).collect()))
    assert sorted(map(tuple, lineage.generations(graph(spark, **nodes), most=2).collect())) == small


def test_leader_step(spark):
    rows = [(None, None, False), ("me", 3, True), ("me", 3, False), (None, 4, False), ("you", 4, True), ("you", 4, False)]
    df = spark.createDataFrame(rows, "owner string, counter long, expired boolean")
    got = [r[0] for r in df.select(leases.leader_step(F.col("owner"), F.col("counter"), F.col("expired"), "me")).collect()]
    assert got == ["create", "renew", "renew", "steal", "steal", "follow"]


def test_released_leadership_is_taken_again():
    store = leases.LeaseStore()
    row, ok = store.run("leader", "lead", "a")
    assert ok
    row, ok = store.run("leader", "release", "a", row.counter)
    assert ok and row.owner is None
    # The step says steal, on the counter that was seen; creating would be refused.
    assert not store.run("leader", "lead", "b")[1]
    row, ok = store.run("leader", "lead", "b", row.counter)
    assert ok and row.owner == "b"


def test_generations(spark):
    got = lineage.generations(graph(spark, a=[], b=["a"], c=["b"], m=["a", "c"], o=["gone"]))
    assert {r["id"]: r["generation"] for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "m": 3, "o": 0}


# --- Leases


def take(spark, rows, me="w1", most=100):
    df = spark.createDataFrame(rows, LEASE_VIEW)
    return sorted(tuple(r) for r in leases.leases_to_take(df, me, most).collect())


def test_take_decisions(spark):
    free = lambda *names: [(n, None, False, False) for n in names]
    held = lambda owner, *names: [(n, owner, False, False) for n in names]
    assert take(spark, free("a", "b")) == [("a", "available"), ("b", "available")]
    assert take(spark, held("w1", "a") + [("b", "w2", True, False)]) == [("b", "available")]
    assert take(spark, held("w1", "a") + held("w2", "b", "c", "d")) == [("b", "steal")]
    assert take(spark, held("w1", "a", "b") + held("w2", "c", "d")) == []
    assert [k for k, _ in take(spark, free("a", "b", "c"), most=2)] == ["a", "b"]
    assert take(spark, [("a", None, False, True), *free("b")]) == [("b", "available")]
    assert take(spark, held("w1", "a") + held("w2", "b", "c")) == []
    assert take(spark, free("a"), most=0) == [] and take(spark, [], most=5) == []
    # The first by name gives among equals.
    assert take(spark, held("w3", "c1", "c2", "c3", "c4") + held("w2", "b1", "b2", "b3", "b4"), most=1) == [("b1", "steal")]


def test_liveness(spark):
    log = [("a", t, c) for t, c in ((0, 1), (5, 2), (15, 2), (16, 2), (30, 3))]
    got = {r["now_ms"]: (r["changed_ms"], r["expired"]) for r in leases.liveness(spark.createDataFrame(log, "worker string, now_ms bigint, counter bigint"), 10).collect()}
    assert got == {0: (0, False), 5: (5, False), 15: (5, False), 16: (5, True), 30: (30, False)}


def test_expiry_follows_the_owner(spark):
    rows = spark.createDataFrame([("a", "w1"), ("b", "w2"), ("c", "w9"), ("d", None), ("__hb__:w2", "w2")], "lease_key string, owner string")
    clocks = spark.createDataFrame([("w1", 0), ("w2", 0)], "worker string, changed_ms bigint")
    got = {r["lease_key"]: r["expired"] for r in leases.with_expiry(rows, clocks, "w1", 11, 10).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False}


def test_guarded_operations():
    store = leases.LeaseStore()
    assert store.run("s", "create", seq="LATEST", parents=["p"])[1] and store.run("s", "create", seq="5")[1]
    row, ok = store.run("s", "acquire", "w1")
    assert ok and (row.owner, row.counter, row.checkpoint) == ("w1", 1, "LATEST")
    assert store.run("s", "checkpoint", "w1", 1, "7")[0].checkpoint == "7"
    assert not store.run("s", "checkpoint", "w1", 1, "8")[1] and not store.run("s", "renew", "w2", 2)[1]
    assert store.run("s", "claim", "w2", 2)[0].owner == "w2" and not store.run("s", "claim", "w1", 2)[1]
    assert not store.run("s", "delete")[1]
    assert store.run("s", "complete", "w2", 3)[0].counter == 3
    assert store.run("s", "release", "w2", 3)[0].owner is None
    assert store.run("s", "delete")[1] and store.get("s") is None
    assert store.run("l", "lead", "w1")[0].counter == 1 and not store.run("l", "lead", "w2")[1]
    assert store.run("l", "lead", "w2", 1)[0].owner == "w2" and not store.run("x", "lead", "w1", 4)[1]
    assert store.run("__hb__:w1", "heartbeat", "w1")[0].counter == 1 and store.run("__hb__:w1", "heartbeat", "w1")[0].counter == 2
    with pytest.raises(ValueError):
        store.run("s", "nonsense")


def test_log_of_operations_is_the_store(spark):
    import random

    r = random.Random(2)
    ops = ["create", "claim", "renew", "checkpoint", "heartbeat", "acquire", "complete", "release", "delete", "lead"]
    log = [(f"k{r.randrange(4)}", at, r.choice(ops), f"w{r.randrange(2)}", r.choice([None, *range(6)]), str(at)) for at in range(600)]
    got = {r["at"]: r for r in leases.apply_log(spark.createDataFrame(log, "lease_key string, at bigint, op string, owner string, counter bigint, seq string")).collect()}
    store = leases.LeaseStore()
    for key, at, op, owner, counter, seq in log:
        row, ok = store.run(key, op, owner, counter, seq)
        assert (got[at]["applied"], got[at]["exists"]) == (ok, row is not None)
        if row:
            assert (got[at]["owner_after"], got[at]["counter_after"], got[at]["checkpoint_after"], got[at]["completed_after"]) == (row.owner, row.counter, row.checkpoint, row.completed)


# --- Delivery


def records(spark, *rows):
    return spark.createDataFrame(rows, "shard_id string, seq string")


def test_order_is_by_length_then_digits(spark):
    rows = records(spark, *[("s", x) for x in ("10", "9", "1" * 39, "2" * 38, "100")])
    got = sorted((r["delivery_pos"], r["seq"]) for r in delivery.with_position(rows).collect())
    assert [s for _, s in got] == ["9", "10", "100", "2" * 38, "1" * 39]


def test_delivered_keeps_shards_whole(spark):
    rows = records(spark, *[(f"s{k % 5}", str(k)) for k in range(200)])
    for part in delivery.delivered(rows).rdd.glom().collect():
        keys = [r["shard_id"] for r in part]
        assert keys == sorted(keys)
        for s in set(keys):
            own = [int(r["seq"]) for r in part if r["shard_id"] == s]
            assert own == sorted(own) and len(own) == 40


def test_resume(spark):
    rows = records(spark, *[("s", str(k)) for k in (9, 10, 11, 12)], ("t", "1"), ("u", "1"), ("v", "1"))
    at = spark.createDataFrame([("s", "11"), ("t", "LATEST"), ("u", "77"), ("v", None)], "shard_id string, checkpoint string")
    assert sorted(tuple(r) for r in delivery.resumed(rows, at).collect()) == [("s", "12"), ("u", "1"), ("v", "1")]


@pytest.mark.parametrize(("interval", "writes"), [(0, 20), (60_000, 1)])
def test_deferral(spark, interval, writes):
    acks = spark.createDataFrame([("s", 10 * k, f"{k + 1:04d}") for k in range(20)], "shard_id string, at_ms bigint, seq string")
    got = delivery.deferred_writes(acks, interval).collect()
    assert len(got) == writes and max(r["seq"] for r in got) == "0020"


def test_idle_backoff(spark):
    polls = spark.createDataFrame([("s", k, k == 5) for k in range(7)], "shard_id string, poll int, got boolean")
    got = [r["sleep_ms"] for r in delivery.idle_schedule(polls).orderBy("poll").collect()]
    assert got == [1000, 2000, 4000, 5000, 5000, 250, 1000]


def test_lag_is_that_of_the_last_record_with_a_time(spark):
    rows = spark.createDataFrame([("s", "9", 50, 5), ("s", "10", None, 5), ("t", "1", 5000, 1), ("u", "1", None, 1)], "shard_id string, seq string, created_ms bigint, bytes bigint")
    got = {r["shard_id"]: (r["records"], r["bytes"], r["checkpoint"], r["lag_ms"]) for r in delivery.shard_metrics(rows, F.lit(1284)).collect()}
    assert got == {"s": (2, 10, "10", 1234), "t": (1, 1, "1", 0), "u": (1, 1, "1", None)}


def test_order_violations_do_not_advance(spark):
    seen = spark.createDataFrame([("k", s, a) for a, s in enumerate([1, 3, 2, 2, 4, 3])], "pk string, sk bigint, arrival bigint")
    assert [(r["sk"], r["highest"]) for r in delivery.order_violations(seen).collect()] == [(2, 3)]


# --- Attribute values

WIRE = {"s": {"S": "x"}, "n": {"N": "42"}, "t": {"Bool": True}, "u": "Null", "b": {"B": [1, 2, 3]}, "ss": {"Ss": ["a", "b"]}, "ns": {"Ns": ["1", "2.5"]}, "bs": {"Bs": [[9]]}, "m": {"M": {"inner": {"N": "7"}}}, "l": {"L": [{"S": "x"}, "Null"]}}
NATIVE = {"s": "x", "n": "42", "t": True, "u": None, "b": "AQID", "ss": ["a", "b"], "ns": ["1", "2.5"], "bs": ["CQ=="], "m": {"inner": "7"}, "l": ["x", None]}
TYPED = {"s": {"S": "x"}, "n": {"N": "42"}, "t": {"BOOL": True}, "u": {"NULL": True}, "b": {"B": "AQID"}, "ss": {"SS": ["a", "b"]}, "ns": {"NS": ["1", "2.5"]}, "bs": {"BS": ["CQ=="]}, "m": {"M": {"inner": {"N": "7"}}}, "l": {"L": [{"S": "x"}, {"NULL": True}]}}


def test_views_of_values(spark):
    images = [json.dumps(WIRE), None, "{}", "not json", "[1]", '{"odd":{"X":1},"two":{"S":"a","N":"1"},"bad":{"B":[300]}}', '{"odd":{"X":1},"two":{"S":"a","N":"1"}}']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(images)], "k int, image string")
    got = [(r["n"] and json.loads(r["n"]), r["t"] and json.loads(r["t"]), r["w"] and json.loads(r["w"])) for r in df.select("k", codec.image_view(F.col("image"), "native").alias("n"), codec.image_view(F.col("image"), "typed_json").alias("t")).withColumn("w", codec.wire_json("t")).orderBy("k").collect()]
    assert got[0] == (NATIVE, TYPED, WIRE)
    assert got[1:6] == [(None, None, None)] * 5
    assert got[6][0] == {"odd": {"X": 1}, "two": {"S": "a", "N": "1"}}
    assert codec.native({"B": [1, 2, 3]}) == b"\x01\x02\x03" and base64.b64encode(codec.native({"B": [1, 2, 3]})) == b"AQID"
    with pytest.raises(ValueError):
        codec.image_view(F.col("image"), "xml")


def test_flat_values_in_sql(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in WIRE.items()] + [("q", '{"S":"a\\"b"}')], "k string, attr string")
    got = {r["k"]: (r["n"], r["t"] and json.loads(r["t"])) for r in df.select("k", codec.scalar_native(F.col("attr")).alias("n"), codec.scalar_typed(F.col("attr")).alias("t")).collect()}
    assert got["s"] == ("x", TYPED["s"]) and got["n"] == ("42", TYPED["n"]) and got["t"] == ("true", TYPED["t"])
    assert got["u"] == (None, TYPED["u"]) and got["b"] == (None, TYPED["b"]) and got["q"] == ('a"b', {"S": 'a"b'}) and got["m"] == (None, None)


# --- Protocol

def batch(shard, *numbers, **fields):
    rows = [{"event_name": "MODIFY", "sequence_number": str(n), "keys": {"id": {"N": str(n)}}, "old_image": None} | fields for n in numbers]
    return {"emit": {"type": "records", "shard": shard, "last_seq": str(numbers[-1]), "records": rows}}


#: A session of its own: three shards, lines that are none, an unknown type, one shard's end before another's batch.
SESSION = [
    {"emit_raw": ""},
    batch("left", 7, 8, 11, new_image={"on": {"Bool": False}}),
    {"emit": {"type": "never_heard_of", "shard": "left"}},
    {"await_checkpoints": [{"shard": "left", "seq": "11"}]},
    {"emit": {"type": "shard_complete", "shard": "left"}},
    {"emit_raw": "[1, 2"},
    batch("right", 3, old_image={}),
    batch("top", 40, event_name="REMOVE"),
    {"await_checkpoints": [{"shard": "top", "seq": "40"}, {"shard": "right", "seq": "3"}]},
    {"emit": {"type": "shutdown", "reason": "enough"}},
]


def test_session(spark, tmp_path):
    path = tmp_path / "session.jsonl"
    path.write_text("\r\n".join(protocol.script_lines(SESSION)) + "\n")
    found = protocol.parse(spark.read.text(str(path)))
    assert [r["type"] for r in found.collect()] == [None, "records", None, "shard_complete", None, "records", "records", "shutdown"]
    rows = protocol.records_of(found).orderBy("shard", "pos").collect()
    assert [(r["shard"], r["sequence_number"], r["event_name"], r["keys"], r["new_image"], r["old_image"]) for r in rows] == [
        *[("left", n, "MODIFY", f'{{"id":{{"N":"{n}"}}}}', '{"on":{"Bool":false}}', None) for n in ("7", "8", "11")],
        ("right", "3", "MODIFY", '{"id":{"N":"3"}}', None, None),
        ("top", "40", "REMOVE", '{"id":{"N":"40"}}', None, None),
    ]
    assert sorted(json.loads(r["line"])["seq"] for r in protocol.acknowledgements(found).collect()) == ["11", "3", "40"]
    with pytest.raises(ValueError):
        protocol.line("nonsense")


# --- Options


def test_options():
    got = ConsumerOptions.from_env({"MILLRACE_MAX_RECORDS": "5000", "MILLRACE_INITIAL_POSITION": " latest ", "MILLRACE_MAX_CONCURRENCY": "0", "MILLRACE_OWNER": "me"})
    assert (got.max_records, got.initial_position, got.max_concurrency, got.owner, got.lease_duration_ms) == (1000, "LATEST", None, "me", 10_000)
    assert ConsumerOptions().initial_position == "TRIM_HORIZON" and ":" in ConsumerOptions().owner
    for bad in ({"initial_position": "now"}, {"record_format": "xml"}):
        with pytest.raises(ValueError):
            ConsumerOptions(**bad)


def test_keys(spark):
    df = spark.createDataFrame([("a:b:c",), ("c",), ("__hb__:w",)], "k string")
    got = [tuple(r) for r in df.select(pos.stream_of(F.col("k")), pos.shard_of(F.col("k")), pos.is_heartbeat(F.col("k"))).collect()]
    assert got == [("a:b", "c", False), (None, "c", False), ("__hb__", "w", True)]
