"""Queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import codec
from millrace.functions import positions as pos
from millrace.operators import delivery, leases, lineage
from millrace.plans import derived as d
from millrace.schema import CLOSED_BY_SYNC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- Delivery ---------------------------------------------------------------------------------------------------


@_query(f"""
WITH {d.CHANGE_LOG}
SELECT shard_id, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(event_id) AS VARCHAR) AS checkpoint,
  greatest(0, {d.NOW_MS} - arg_max(created_ms, event_id)) AS lag_ms
FROM change_log GROUP BY shard_id
""")
def flagship_shard_summary(spark, sf):
    return delivery.shard_metrics(d.change_log(spark, sf), F.lit(d.NOW_MS))


@_query(f"""
WITH {d.CHANGE_LOG}
SELECT event_name, shard_id, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT pk) AS keys
FROM change_log GROUP BY event_name, shard_id
""")
def batch_metrics_by_event(spark, sf):
    return d.change_log(spark, sf).groupBy("event_name", "shard_id").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.count_distinct("pk").alias("keys"))


@_query(f"""
WITH {d.CHANGE_LOG}
SELECT shard_id, seq, row_number() OVER (PARTITION BY shard_id ORDER BY length(seq), seq) AS delivery_pos FROM change_log
""")
def ordered_delivery(spark, sf):
    return delivery.with_position(d.change_log(spark, sf)).select("shard_id", "seq", F.col("delivery_pos").cast("long").alias("delivery_pos"))


@_query(f"""
WITH {d.CHECKPOINTS}
SELECT c.shard_id, c.seq FROM change_log c LEFT JOIN checkpoints k ON c.shard_id = k.shard_id
WHERE k.checkpoint IS NULL OR (k.checkpoint <> 'LATEST' AND (length(c.seq) > length(k.checkpoint) OR (length(c.seq) = length(k.checkpoint) AND c.seq > k.checkpoint)))
""")
def resume_after_checkpoint(spark, sf):
    return delivery.resumed_in_order(d.change_log(spark, sf), d.checkpoints(spark, sf)).select("shard_id", "seq")


@_query(f"""
WITH {d.CHECKPOINTS}
SELECT c.shard_id, c.seq FROM change_log c LEFT JOIN checkpoints k ON c.shard_id = k.shard_id
WHERE k.checkpoint IS NULL OR (k.checkpoint <> 'LATEST' AND (
  NOT EXISTS (SELECT 1 FROM change_log x WHERE x.shard_id = k.shard_id AND x.seq = k.checkpoint)
  OR length(c.seq) > length(k.checkpoint) OR (length(c.seq) = length(k.checkpoint) AND c.seq > k.checkpoint)))
""")
def resume_unknown_token(spark, sf):
    return delivery.resumed(d.change_log(spark, sf), d.checkpoints(spark, sf)).select("shard_id", "seq")


@_query(f"""
WITH {d.CHANGE_LOG}
SELECT shard_id, page, count(*) AS records, CAST(max(event_id) AS VARCHAR) AS last_seq
FROM (SELECT *, (row_number() OVER (PARTITION BY shard_id ORDER BY length(seq), seq) + 99) // 100 AS page FROM change_log)
GROUP BY shard_id, page
""")
def page_numbers(spark, sf):
    pages = delivery.paged(d.change_log(spark, sf), 100)
    return pages.groupBy("shard_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("records"), delivery.last_of_batch().alias("last_seq"))


@_query("SELECT DISTINCT user_id * 37 - 50 AS asked, greatest(1, least(1000, user_id * 37 - 50)) AS size FROM events")
def max_records_clamp(spark, sf):
    asked = d.table(spark, sf, "events").select((F.col("user_id") * 37 - 50).alias("asked")).distinct()
    return asked.select("asked", pos.fetch_size(F.col("asked")).alias("size"))


@_query(f"""
WITH {d.CHANGE_LOG}, seen AS (SELECT user_id AS pk, CAST(value * 100 AS BIGINT) AS sk, event_id AS arrival FROM change_log),
firsts AS (SELECT pk, sk, min(arrival) AS arrival FROM seen GROUP BY pk, sk),
above AS (SELECT *, max(sk) OVER (PARTITION BY pk ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM firsts)
SELECT pk, sk, arrival, highest FROM above WHERE sk < highest
""")
def order_violations(spark, sf):
    seen = d.change_log(spark, sf).select(F.col("user_id").alias("pk"), F.round(F.col("value") * 100).cast("long").alias("sk"), F.col("event_id").alias("arrival"))
    return delivery.order_violations(seen)


def _redelivered(spark, sf):
    """A log in which every tenth record comes twice, and every hundredth never."""
    log = d.change_log(spark, sf).select("shard_id", "seq", "event_id")
    return log.where("event_id % 100 <> 7").unionByName(log.where("event_id % 10 = 0"))


_REDELIVERED = f"""
WITH {d.CHANGE_LOG}, redelivered AS (
  SELECT shard_id, seq, event_id FROM change_log WHERE event_id % 100 <> 7 UNION ALL SELECT shard_id, seq, event_id FROM change_log WHERE event_id % 10 = 0
)"""


@_query(f"{_REDELIVERED} SELECT shard_id, seq, count(*) - 1 AS extra FROM redelivered GROUP BY shard_id, seq HAVING count(*) > 1")
def duplicate_count(spark, sf):
    return delivery.duplicates(_redelivered(spark, sf), ["shard_id", "seq"])


@_query(f"{_REDELIVERED} SELECT shard_id, count(DISTINCT seq) AS records FROM redelivered GROUP BY shard_id")
def deduplicated_delivery(spark, sf):
    return delivery.deduplicated(_redelivered(spark, sf)).groupBy("shard_id").agg(F.count("*").alias("records"))


@_query(f"{_REDELIVERED} SELECT shard_id, seq FROM change_log EXCEPT SELECT shard_id, seq FROM redelivered")
def completeness_missing(spark, sf):
    return delivery.missing(d.change_log(spark, sf), _redelivered(spark, sf), ["shard_id", "seq"])


@_query(f"""
WITH {d.CHANGE_LOG}, polls AS (SELECT shard_id, event_id AS poll, event_name = 'INSERT' AS got FROM change_log),
islands AS (SELECT *, sum(CAST(got AS INT)) OVER (PARTITION BY shard_id ORDER BY poll ROWS UNBOUNDED PRECEDING) AS island FROM polls),
numbered AS (SELECT *, row_number() OVER (PARTITION BY shard_id, island, got ORDER BY poll) AS nth FROM islands)
SELECT shard_id, poll, got, CAST(CASE WHEN got THEN 250 ELSE least(1000 * power(2, least(nth - 1, 30)), 5000) END AS BIGINT) AS sleep_ms FROM numbered
""")
def idle_backoff(spark, sf):
    return delivery.idle_schedule(d.change_log(spark, sf).select("shard_id", F.col("event_id").alias("poll"), (F.col("event_name") == "INSERT").alias("got")))


@_query(f"""
WITH {d.CHANGE_LOG} SELECT shard_id, min(created_ms + bytes) AS due_at FROM change_log GROUP BY shard_id
""")
def next_due(spark, sf):
    return delivery.next_due(d.change_log(spark, sf).select("shard_id", (F.col("created_ms") + F.col("bytes")).alias("due_at")))


@_query(f"""
WITH RECURSIVE {d.ACKS},
writes(shard_id, at_ms) AS (
  SELECT shard_id, min(at_ms) FROM acks GROUP BY shard_id
  UNION ALL
  SELECT w.shard_id, (SELECT min(a.at_ms) FROM acks a WHERE a.shard_id = w.shard_id AND a.at_ms >= w.at_ms + 3600000) FROM writes w
  WHERE EXISTS (SELECT 1 FROM acks a WHERE a.shard_id = w.shard_id AND a.at_ms >= w.at_ms + 3600000)
),
first AS (SELECT shard_id, min(at_ms) AS at_ms FROM acks GROUP BY shard_id),
last AS (SELECT shard_id, max(at_ms) AS at_ms FROM writes GROUP BY shard_id),
flushed AS (SELECT a.shard_id, max(a.at_ms) AS at_ms FROM acks a JOIN last l ON a.shard_id = l.shard_id JOIN first f ON a.shard_id = f.shard_id WHERE a.at_ms > l.at_ms OR l.at_ms = f.at_ms GROUP BY a.shard_id)
SELECT a.shard_id, a.at_ms, a.seq, FALSE AS forced FROM acks a JOIN writes w ON a.shard_id = w.shard_id AND a.at_ms = w.at_ms JOIN first f ON f.shard_id = a.shard_id WHERE a.at_ms > f.at_ms
UNION ALL SELECT a.shard_id, a.at_ms, a.seq, TRUE FROM acks a JOIN flushed f ON a.shard_id = f.shard_id AND a.at_ms = f.at_ms
""")
def deferred_writes(spark, sf):
    return delivery.deferred_writes(d.acks(spark, sf), 3_600_000)


# --- Positions and keys -----------------------------------------------------------------------------------------


@_query(f"""
WITH {d.CHECKPOINTS}
SELECT shard_id, checkpoint, CASE WHEN checkpoint IS NULL THEN 'TRIM_HORIZON' WHEN checkpoint = 'LATEST' THEN 'LATEST' ELSE 'AFTER' END AS kind,
  checkpoint IS NULL OR checkpoint = 'LATEST' AS start_mode, checkpoint AS round_trip
FROM checkpoints
""")
def start_position_decode(spark, sf):
    cp = F.col("checkpoint")
    return d.checkpoints(spark, sf).select("shard_id", "checkpoint", pos.start_kind(cp).alias("kind"), pos.start_mode(cp).alias("start_mode"), pos.as_checkpoint(pos.start_kind(cp), cp).alias("round_trip"))


_SPELLINGS = ("TRIM_HORIZON", " trim-horizon ", "TrimHorizon", "latest", " LATEST", "after", "", "TRIM HORIZON")


@_query(f"""
WITH spelt AS (SELECT event_id, ['{"', '".join(_SPELLINGS)}'][1 + event_id % {len(_SPELLINGS)}] AS given FROM events),
named AS (SELECT event_id, given, CASE WHEN upper(trim(given)) IN ('TRIM_HORIZON', 'TRIM-HORIZON', 'TRIMHORIZON') THEN 'TRIM_HORIZON' WHEN upper(trim(given)) = 'LATEST' THEN 'LATEST' END AS position FROM spelt)
SELECT event_id, given, position, CASE WHEN position = 'LATEST' THEN 'LATEST' END AS seed FROM named
""")
def initial_position_parse(spark, sf):
    spelt = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (1 + F.col("event_id") % len(_SPELLINGS)).cast("int"))
    named = d.table(spark, sf, "events").select("event_id", spelt.alias("given")).withColumn("position", pos.initial_position(F.col("given")))
    return named.withColumn("seed", pos.seed_checkpoint(F.col("position")))


@_query("""
SELECT event_id, 'stream' || (user_id % 3) || ':' || event_id AS multi, CAST(event_id AS VARCHAR) AS single, '__hb__:w' || (user_id % 5) AS heartbeat FROM events
""")
def lease_key_build(spark, sf):
    shard = F.col("event_id").cast("string")
    stream = F.concat(F.lit("stream"), (F.col("user_id") % 3).cast("string"))
    worker = F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string"))
    return d.table(spark, sf, "events").select("event_id", pos.lease_key(stream, shard).alias("multi"), pos.lease_key(None, shard).alias("single"), pos.heartbeat_key(worker).alias("heartbeat"))


@_query("""
WITH keys AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'arn:x:y:table/t' || c_nationkey || ':' || c_name WHEN 1 THEN c_name WHEN 2 THEN '__hb__:' || c_name ELSE '__shard_sync_leader__' END AS key FROM customer)
SELECT key, CASE WHEN contains(key, ':') THEN regexp_extract(key, '^(.*):([^:]*)$', 1) END AS stream, regexp_extract(key, '([^:]*)$', 1) AS shard,
  starts_with(key, '__hb__:') AS heartbeat, starts_with(key, '__hb__:') OR key = '__shard_sync_leader__' AS pseudo FROM keys
""")
def lease_key_parse(spark, sf):
    name, k = F.col("c_name"), F.col("c_custkey") % 4
    key = F.when(k == 0, F.concat(F.lit("arn:x:y:table/t"), F.col("c_nationkey").cast("string"), F.lit(":"), name)).when(k == 1, name).when(k == 2, pos.heartbeat_key(name)).otherwise("__shard_sync_leader__")
    keys, key = d.table(spark, sf, "customer").select(key.alias("key")), F.col("key")
    return keys.select("key", pos.stream_of(key).alias("stream"), pos.shard_of(key).alias("shard"), pos.is_heartbeat(key).alias("heartbeat"), pos.is_pseudo(key).alias("pseudo"))


@_query(f"""
WITH {d.SHARD_LEASES},
parents AS (SELECT s.id, l.parent, k.checkpoint FROM shards s LEFT JOIN links l ON l.id = s.id LEFT JOIN shard_leases k ON k.lease_key = l.parent)
SELECT id, CASE WHEN count(parent) > 0 AND bool_and(coalesce(checkpoint = 'LATEST', FALSE)) THEN 'LATEST' END AS checkpoint FROM parents GROUP BY id
""")
def child_seed_checkpoint(spark, sf):
    return lineage.seeded_children(d.shards(spark, sf), d.shard_leases(spark, sf))


# --- Attribute values -------------------------------------------------------------------------------------------


def _attributes(spark, sf):
    n, pk, user = F.col("event_id") % 4, F.col("pk"), F.col("user_id").cast("string")
    attr = F.when(n == 0, F.concat(F.lit('{"S":"'), pk, F.lit('"}'))).when(n == 1, F.concat(F.lit('{"N":"'), user, F.lit('"}'))).when(n == 2, '{"Bool":true}').otherwise('"Null"')
    return d.change_log(spark, sf).select("event_id", attr.alias("attr"))


@_query(f"""
WITH {d.CHANGE_LOG} SELECT event_id, CASE event_id % 4 WHEN 0 THEN pk WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'true' END AS native FROM change_log
""")
def attr_native(spark, sf):
    return _attributes(spark, sf).select("event_id", codec.scalar_native(F.col("attr")).alias("native"))


@_query(f"""
WITH {d.CHANGE_LOG} SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{{"S":"' || pk || '"}}' WHEN 1 THEN '{{"N":"' || user_id || '"}}' WHEN 2 THEN '{{"BOOL":true}}' ELSE '{{"NULL":true}}' END AS typed FROM change_log
""")
def attr_typed_json(spark, sf):
    return _attributes(spark, sf).select("event_id", codec.scalar_typed(F.col("attr")).alias("typed"))


@_query(f"""
WITH {d.CHANGE_LOG} SELECT event_id, '{{"event_name":"' || event_name || '","sequence_number":"' || seq || '"' || CASE WHEN event_id % 3 > 0 THEN ',"approx_creation_time_ms":' || created_ms ELSE '' END || '}}' AS payload FROM change_log
""")
def attr_encode_wire(spark, sf):
    event = F.struct("event_name", F.col("seq").alias("sequence_number"), F.when(F.col("event_id") % 3 > 0, F.col("created_ms")).alias("approx_creation_time_ms"))
    return d.change_log(spark, sf).select("event_id", codec.encode_event(event).cast("string").alias("payload"))


@_query(f"""
WITH {d.CHANGE_LOG}, bytes AS (SELECT event_id, user_id, to_base64(unhex('0102' || printf('%02X', CAST(user_id % 256 AS INT)))) AS b FROM change_log)
SELECT event_id, '{{"a":{{"b":["x",null,"' || user_id || '"],"c":true}},"z":"' || b || '"}}' AS native,
  '{{"a":{{"M":{{"b":{{"L":[{{"S":"x"}},{{"NULL":true}},{{"N":"' || user_id || '"}}]}},"c":{{"BOOL":true}}}}}},"z":{{"B":"' || b || '"}}}}' AS typed, TRUE AS round_trip
FROM bytes
""")
def attr_recursive(spark, sf):
    user = F.col("user_id").cast("string")
    image = F.concat(F.lit('{"z":{"B":[1,2,'), (F.col("user_id") % 256).cast("string"), F.lit(']},"a":{"M":{"b":{"L":[{"S":"x"},"Null",{"N":"'), user, F.lit('"}]},"c":{"Bool":true}}}}'))
    rows = d.change_log(spark, sf).select("event_id", image.alias("image"))
    seen = rows.select("event_id", "image", codec.views("image").alias("v"))
    same = F.to_json(F.parse_json("v.wire")) == F.to_json(F.parse_json("image"))
    return seen.select("event_id", "v.native", "v.typed", same.alias("round_trip"))


# --- Lineage ----------------------------------------------------------------------------------------------------


@_query(f"WITH {d.RAW_SHARDS} SELECT shard_id, parent_shard_id, ending_sequence_number, page, pos FROM first_seen")
def dedup_first_seen(spark, sf):
    return lineage.first_seen(d.raw_shards(spark, sf))


@_query(f"""
WITH {d.RAW_SHARDS}
SELECT f.shard_id AS id, coalesce(p.shard_id, '') AS parents FROM first_seen f LEFT JOIN first_seen p ON f.parent_shard_id = p.shard_id
""")
def shard_graph_build(spark, sf):
    return lineage.shard_graph(d.raw_shards(spark, sf)).select("id", F.array_join("parents", ",").alias("parents"))


@_query(f"""
WITH {d.RAW_SHARDS}, existing AS (SELECT shard_id AS id FROM first_seen WHERE page < 1)
SELECT f.shard_id AS id, CASE WHEN f.page < 1 THEN '' ELSE coalesce(p.shard_id, '') END AS parents FROM first_seen f LEFT JOIN first_seen p ON f.parent_shard_id = p.shard_id
""")
def merge_children(spark, sf):
    raw = d.raw_shards(spark, sf)
    existing = lineage.shard_graph(lineage.first_seen(raw).where("page < 1"))
    return lineage.merge_children(existing, raw).select("id", F.array_join("parents", ",").alias("parents"))


@_query(f"""
WITH {d.RAW_SHARDS}
SELECT shard_id, CASE WHEN ending_sequence_number IS NULL AND EXISTS (SELECT 1 FROM first_seen c WHERE c.parent_shard_id = s.shard_id) THEN '{CLOSED_BY_SYNC}' ELSE ending_sequence_number END AS ending_sequence_number
FROM first_seen s
""")
def close_open_parents(spark, sf):
    return lineage.close_open_parents(lineage.first_seen(d.raw_shards(spark, sf))).select("shard_id", "ending_sequence_number")


@_query(f"WITH {d.RAW_SHARDS} SELECT shard_id, parent_shard_id FROM first_seen WHERE parent_shard_id = 'shard-0-g0'")
def child_shards(spark, sf):
    return lineage.child_shards(lineage.first_seen(d.raw_shards(spark, sf)), "shard-0-g0").select("shard_id", "parent_shard_id")


_WAITING = "SELECT l.id FROM links l WHERE l.parent NOT IN (SELECT lease_key FROM shard_leases WHERE completed)"


@_query(f"""
WITH {d.SHARD_LEASES} SELECT id FROM shards WHERE id NOT IN (SELECT lease_key FROM shard_leases WHERE completed) AND id NOT IN ({_WAITING})
""")
def eligible_strict(spark, sf):
    done = d.shard_leases(spark, sf).where("completed").select(F.col("lease_key").alias("id"))
    return lineage.eligible(d.shards(spark, sf), done)


def _collected(spark, sf):
    """A graph from which the first generation has been deleted, its children still naming it."""
    return d.shards(spark, sf).where("id not like '%-g0'")


@_query(f"""
WITH {d.SHARD_LEASES}, kept AS (SELECT id FROM shards WHERE id NOT LIKE '%-g0')
SELECT id FROM kept WHERE id NOT IN (SELECT lease_key FROM shard_leases WHERE completed) AND id NOT IN ({_WAITING} AND l.parent IN (SELECT id FROM kept))
""")
def eligible_gc_tolerant(spark, sf):
    done = d.shard_leases(spark, sf).where("completed").select(F.col("lease_key").alias("id"))
    return lineage.eligible(_collected(spark, sf), done, missing_blocks=False)


@_query(f"""
WITH RECURSIVE {d.SHARDS}, walk(id, generation) AS (
  SELECT id, 0 FROM shards WHERE id NOT IN (SELECT id FROM links) UNION ALL SELECT l.id, w.generation + 1 FROM walk w JOIN links l ON l.parent = w.id
) SELECT id, max(generation) AS generation FROM walk GROUP BY id
""")
def lineage_generation(spark, sf):
    return lineage.generations(d.shards(spark, sf))


@_query(f"""
WITH {d.SHARD_LEASES}, state AS (SELECT lease_key, completed, completed OR (checkpoint IS NOT NULL AND checkpoint <> 'LATEST') AS processing FROM shard_leases)
SELECT l.parent AS id FROM links l LEFT JOIN state c ON c.lease_key = l.id WHERE l.parent IN (SELECT lease_key FROM state WHERE completed)
GROUP BY l.parent HAVING bool_and(coalesce(c.processing OR c.completed, FALSE))
""")
def safe_to_delete(spark, sf):
    return lineage.safe_to_delete(d.shards(spark, sf), lineage.cleanup_state(d.shard_leases(spark, sf)))


@_query(f"""
WITH {d.SHARD_LEASES}, few AS (SELECT * FROM shard_leases WHERE lease_key NOT LIKE 'shard-2-%' AND lease_key <> 'shard-1-g1')
SELECT id, CAST('LATEST' AS VARCHAR) AS checkpoint FROM shards WHERE id NOT IN (SELECT lease_key FROM few)
  AND id NOT IN (SELECT l.id FROM links l WHERE l.parent NOT IN (SELECT lease_key FROM few WHERE completed))
""")
def seed_roots(spark, sf):
    few = d.shard_leases(spark, sf).where("lease_key not like 'shard-2-%' and lease_key <> 'shard-1-g1'")
    return lineage.roots_to_seed(d.shards(spark, sf), few, "LATEST")


@_query(f"""
WITH {d.SHARD_LEASES}, few AS (SELECT * FROM shard_leases WHERE lease_key NOT LIKE '%-g1' AND lease_key NOT LIKE '%-m%')
SELECT lease_key AS id FROM few WHERE completed AND lease_key NOT IN (SELECT l.parent FROM links l JOIN few f ON f.lease_key = l.id) AND lease_key <> 'shard-3-g0'
""")
def sync_children(spark, sf):
    few = d.shard_leases(spark, sf).where("lease_key not like '%-g1' and lease_key not like '%-m%'")
    return lineage.parents_to_sync(few, spark.createDataFrame([("shard-3-g0",)], "id string"))


@_query(f"""
WITH RECURSIVE {d.SHARDS}, walk(id, generation) AS (
  SELECT id, 0 FROM shards WHERE id NOT IN (SELECT id FROM links) UNION ALL SELECT l.id, w.generation + 1 FROM walk w JOIN links l ON l.parent = w.id
), depth AS (SELECT id, max(generation) AS generation FROM walk GROUP BY id)
SELECT c.shard_id, c.seq, g.generation, CAST(row_number() OVER (PARTITION BY c.shard_id ORDER BY length(c.seq), c.seq) AS BIGINT) AS place FROM change_log c JOIN depth g ON g.id = c.shard_id
""")
def topological_drain(spark, sf):
    found = lineage.delivery_order(d.change_log(spark, sf), d.shards(spark, sf))
    return found.select("shard_id", "seq", "generation", F.col("place").cast("long").alias("place"))


# --- Leases -----------------------------------------------------------------------------------------------------


@_query(f"WITH {d.LEASES} SELECT owner, count(*) AS n FROM leases WHERE NOT completed AND NOT expired AND owner IS NOT NULL GROUP BY owner")
def owner_counts(spark, sf):
    return leases.owner_counts(d.leases(spark, sf))


_SHARE = """
share AS (
  SELECT count(*) AS active, count(DISTINCT CASE WHEN owner IS NOT NULL AND NOT expired AND owner <> 'w2' THEN owner END) + 1 AS workers,
    count(*) FILTER (WHERE owner = 'w2' AND NOT expired) AS mine FROM leases WHERE NOT completed
), target AS (SELECT *, (active + workers - 1) // workers AS target FROM share)"""


@_query(f"WITH {d.LEASES}, {_SHARE} SELECT active, workers, target, mine FROM target")
def fair_share_target(spark, sf):
    return leases.fair_share(d.leases(spark, sf), "w2")


def _take_sql(source: str, most: int) -> str:
    return f"""
WITH {source}, {_SHARE},
live AS (SELECT * FROM leases WHERE NOT completed),
available AS (
  SELECT lease_key, row_number() OVER (ORDER BY lease_key) AS k FROM live WHERE owner IS NULL OR (expired AND owner <> 'w2')
),
need AS (SELECT greatest(0, least(target - mine, {most})) AS need, target FROM target),
first AS (SELECT lease_key FROM available, need WHERE k <= need),
others AS (SELECT owner, count(*) AS n FROM live WHERE NOT expired AND owner IS NOT NULL AND owner <> 'w2' GROUP BY owner),
victim AS (SELECT owner, n FROM others ORDER BY n DESC, owner LIMIT 1),
held AS (SELECT l.lease_key, v.n, row_number() OVER (ORDER BY l.lease_key) AS k FROM live l JOIN victim v ON l.owner = v.owner WHERE NOT l.expired),
stolen AS (SELECT lease_key FROM held, need WHERE n > target AND k <= least(n - target, need - (SELECT count(*) FROM first)))
SELECT lease_key, 'available' AS how FROM first UNION ALL SELECT lease_key, 'steal' FROM stolen
"""


@_query(_take_sql(d.LEASES, 100))
def take_available(spark, sf):
    return leases.leases_to_take(d.leases(spark, sf), "w2", 100)


@_query(_take_sql(d.LEASES_SKEWED, 400))
def take_with_steal(spark, sf):
    return leases.leases_to_take(d.leases(spark, sf, skewed=True), "w2", 400)


@_query(f"""
WITH {d.SNAPSHOTS},
before AS (SELECT *, lag(counter) OVER (PARTITION BY worker ORDER BY now_ms) AS pc FROM snapshots),
clocks AS (SELECT worker, now_ms, counter, max(CASE WHEN pc IS NULL OR pc <> counter THEN now_ms END) OVER (PARTITION BY worker ORDER BY now_ms ROWS UNBOUNDED PRECEDING) AS changed_ms FROM before)
SELECT worker, now_ms, counter, changed_ms, now_ms - changed_ms > 20 AS expired FROM clocks
""")
def liveness_expired(spark, sf):
    return leases.liveness(d.snapshots(spark, sf), 20)


@_query(f"""
WITH {d.LEASES}, {d.SNAPSHOTS},
before AS (SELECT *, lag(counter) OVER (PARTITION BY worker ORDER BY now_ms) AS pc FROM snapshots),
clocks AS (SELECT worker, max(now_ms) AS changed_ms FROM before WHERE pc IS NULL OR pc <> counter GROUP BY worker),
clock AS (SELECT max(now_ms) AS now_ms FROM snapshots)
SELECT l.lease_key, l.owner, coalesce(l.owner <> 'w2' AND (SELECT now_ms FROM clock) - c.changed_ms > 5, FALSE) AS expired FROM leases l LEFT JOIN clocks c ON c.worker = l.owner
""")
def leases_with_expiry(spark, sf):
    log = leases.liveness(d.snapshots(spark, sf), 5)
    clocks = log.groupBy("worker").agg(F.max("changed_ms").alias("changed_ms"))
    now = d.snapshots(spark, sf).agg(F.max("now_ms")).first()[0] or 0
    return leases.with_expiry(d.leases(spark, sf).drop("expired"), clocks, "w2", now, 5).select("lease_key", "owner", "expired")


@_query(f"""
WITH {d.LEASES}, rows_seen AS (SELECT lease_key, CASE WHEN counter % 5 > 0 THEN owner END AS owner, CASE WHEN counter % 5 > 0 THEN counter END AS counter, expired FROM leases)
SELECT lease_key, CASE WHEN counter IS NULL THEN 'create' WHEN owner = 'w2' THEN 'renew' WHEN owner IS NULL OR expired THEN 'steal' ELSE 'follow' END AS decision,
  owner IS NULL OR counter = 2 AS takeable FROM rows_seen
""")
def leader_decision(spark, sf):
    """Leases whose counter is a multiple of five stand for rows that are missing."""
    there = F.col("counter") % 5 > 0
    rows = d.leases(spark, sf).select("lease_key", F.when(there, F.col("owner")).alias("owner"), F.when(there, F.col("counter")).alias("counter"), "expired")
    return rows.select("lease_key", leases.leader_step(F.col("owner"), F.col("counter"), F.col("expired"), "w2").alias("decision"), leases.takeable(F.col("owner"), F.col("counter"), F.lit(2)).alias("takeable"))


@_query(f"WITH {d.LEASES} SELECT lease_key FROM leases WHERE owner = 'w2' AND NOT completed")
def owned_shards(spark, sf):
    return leases.owned(d.leases(spark, sf), "w2").select("lease_key")


@_query(f"WITH {d.LEASES} SELECT owner, count(*) FILTER (WHERE NOT completed) AS held FROM leases WHERE owner IS NOT NULL GROUP BY owner")
def leases_held(spark, sf):
    return leases.leases_held(d.leases(spark, sf))


@_query(f"WITH {d.LEASES} SELECT count(*) > 0 AND coalesce(bool_and(completed), FALSE) AS all_complete FROM leases")
def all_complete(spark, sf):
    return leases.all_complete(d.leases(spark, sf))


@_query(f"""
WITH {d.SHARD_LEASES} SELECT id, coalesce(string_agg(parent, ',' ORDER BY parent), '') AS parents
FROM (SELECT s.id, l.parent FROM shards s LEFT JOIN links l ON l.id = s.id WHERE s.id NOT LIKE 'shard-t%' AND s.id <> 'shard-3-g2') GROUP BY id
""")
def graph_from_leases(spark, sf):
    return lineage.graph_from_leases(d.shard_leases(spark, sf)).select("id", F.array_join("parents", ",").alias("parents"))


@_query(f"""
WITH RECURSIVE {d.CHANGE_LOG},
ops AS (
  SELECT pk AS k, event_id AS moment, list_value('create', 'claim', 'renew', 'checkpoint', 'heartbeat', 'acquire', 'complete', 'release', 'delete', 'lead')[1 + event_id % 10] AS op,
    'w' || (event_id % 2) AS who, seq, row_number() OVER (PARTITION BY pk ORDER BY event_id) AS nth
  FROM change_log
),
asked AS (SELECT *, CASE WHEN moment % 7 > 0 THEN (nth - 1) % 5 END AS saw FROM ops),
fold AS (
  SELECT k, CAST(0 AS BIGINT) AS nth, FALSE AS there, CAST(NULL AS VARCHAR) AS owner, CAST(0 AS BIGINT) AS counter, CAST(NULL AS VARCHAR) AS checkpoint, FALSE AS completed,
    CAST(NULL AS BIGINT) AS moment, CAST(NULL AS VARCHAR) AS op, FALSE AS ok
  FROM (SELECT DISTINCT k FROM asked)
  UNION ALL
  SELECT k, nth, CASE WHEN op = 'delete' AND ok THEN FALSE ELSE there OR (ok AND op IN ('create', 'acquire', 'heartbeat', 'lead')) END,
    CASE WHEN NOT ok OR op = 'create' OR op = 'delete' THEN CASE WHEN op = 'delete' AND ok THEN NULL ELSE owner END WHEN op = 'release' THEN NULL ELSE who END,
    CASE WHEN NOT ok OR op IN ('create', 'complete') THEN counter WHEN op = 'delete' THEN 0 ELSE counter + 1 END,
    CASE WHEN ok AND (op = 'checkpoint' OR (op = 'create' AND NOT there)) THEN seq WHEN ok AND op = 'delete' THEN NULL ELSE checkpoint END,
    CASE WHEN ok AND op = 'delete' THEN FALSE ELSE completed OR (ok AND op = 'complete') END, moment, op, ok
  FROM (
    SELECT a.k, a.nth, a.moment, a.op, a.who, a.seq, f.there, f.owner, f.counter, f.checkpoint, f.completed,
      CASE a.op WHEN 'create' THEN TRUE WHEN 'acquire' THEN TRUE WHEN 'heartbeat' THEN TRUE
        WHEN 'claim' THEN coalesce(f.there AND f.counter = a.saw, FALSE)
        WHEN 'lead' THEN CASE WHEN f.there THEN coalesce(f.counter = a.saw, FALSE) ELSE a.saw IS NULL END
        WHEN 'delete' THEN f.there AND f.completed
        ELSE coalesce(f.there AND f.counter = a.saw AND f.owner = a.who, FALSE) END AS ok
    FROM fold f JOIN asked a ON a.k = f.k AND a.nth = f.nth + 1
  )
)
SELECT k AS lease_key, moment AS "at", op, ok AS applied, there AS exists, CASE WHEN there THEN owner END AS owner_after, CASE WHEN there THEN counter END AS counter_after,
  CASE WHEN there THEN checkpoint END AS checkpoint_after, CASE WHEN there THEN completed END AS completed_after
FROM fold WHERE nth > 0
""")
def lease_oplog_apply(spark, sf):
    """Requests derived from the change log: about half carry a counter that is still right."""
    log = d.change_log(spark, sf)
    ops = F.array(*map(F.lit, ("create", "claim", "renew", "checkpoint", "heartbeat", "acquire", "complete", "release", "delete", "lead")))
    nth = F.row_number().over(Window.partitionBy("pk").orderBy("event_id")) - 1
    return leases.apply_log(
        log.select(
            F.col("pk").alias("lease_key"), F.col("event_id").alias("at"), F.element_at(ops, (1 + F.col("event_id") % 10).cast("int")).alias("op"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("owner"),
            F.when(F.col("event_id") % 7 > 0, nth.cast("long") % 5).alias("counter"), "seq",
        )
    )


# --- Protocol and streaming -------------------------------------------------------------------------------------


@_query(f"""
WITH {d.CHANGE_LOG}
SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'shard_complete' WHEN 2 THEN 'shutdown' ELSE 'records' END AS type,
  CASE WHEN event_id % 5 IN (1, 3, 4) THEN shard_id END AS shard, CASE WHEN event_id % 5 > 2 THEN seq END AS last_seq, CASE WHEN event_id % 5 > 2 THEN 1 END AS n, CASE WHEN event_id % 5 = 2 THEN 'done' END AS reason
FROM change_log
""")
def protocol_parse(spark, sf):
    from millrace.sources import protocol

    shard, seq, n = F.col("shard_id"), F.col("seq"), F.col("event_id") % 5
    quoted = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    records = quoted('{"type":"records","shard":"', shard, '","last_seq":"', seq, '","records":[{"event_name":"', F.col("event_name"), '","sequence_number":"', seq, '","keys":{"pk":{"S":"', F.col("pk"), '"}}}]}\r\n')
    line = F.when(n == 0, "{not json").when(n == 1, quoted('{"type":"shard_complete","shard":"', shard, '"}')).when(n == 2, '{"type":"shutdown","reason":"done"}\n').otherwise(records)
    found = protocol.parse(d.change_log(spark, sf).select("event_id", line.alias("value")))
    return found.select("event_id", "type", "shard", "last_seq", F.when(F.col("records").isNotNull(), F.size("records")).alias("n"), "reason")


@_query(f"""
WITH {d.CHANGE_LOG} SELECT shard_id, count(*) AS records, CAST(max(event_id) AS VARCHAR) AS checkpoint, shard_id LIKE '%-g0' OR shard_id LIKE '%-g1' AS ended FROM change_log GROUP BY shard_id
""")
def stream_drain(spark, sf):
    """The change log written as a shard log, consumed by a worker to its end, and what was acknowledged."""
    import uuid

    from millrace.session import shared_dir
    from millrace.sources import shardlog
    from millrace.streaming.worker import Totals, Worker

    root = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"
    log = d.change_log(spark, sf).select("shard_id", "seq", F.col("pk").alias("data"), "root", "gen")
    graph = log.select("shard_id", "root", "gen").distinct().select(F.col("shard_id").alias("id"), F.when(F.col("gen") > 0, F.array(F.concat(F.lit("shard-"), F.col("root").cast("string"), F.lit("-g"), (F.col("gen") - 1).cast("string")))).otherwise(F.array().cast("array<string>")).alias("parents"), F.col("gen").between(0, 1).alias("ended"))
    shardlog.write_log(log, graph, f"{root}/log")
    totals = Totals()
    done = Worker(spark, f"{root}/log", f"{root}/state", _Counter, metrics=totals).run()
    rows = [(s, totals.records[s], done[s], s in totals.ended) for s in sorted(done)]
    return spark.createDataFrame(rows, "shard_id string, records bigint, checkpoint string, ended boolean")


class _Counter:
    """A processor that takes all it gets."""

    def process_records(self, shard: str, records: list[dict]) -> None:
        pass
