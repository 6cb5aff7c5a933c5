"""Inputs of the queries, derived from the driver's tables: in DataFrame terms here, in SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What the clock shows when lag is measured: epoch milliseconds of 2024-02-15.
NOW_MS = 1_707_955_200_000


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # The timestamps have no zone: so has the epoch that they are measured from.
    created = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ)) div 1000")
    gen = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10).cast("int"))
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "REMOVE").otherwise("MODIFY")
    root = F.col("user_id") % 4
    return events.select(
        F.concat(F.lit("shard-"), root.cast("string"), F.lit("-g"), gen.cast("string")).alias("shard_id"),
        F.col("event_id").cast("string").alias("seq"),
        kind.alias("event_name"),
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("pk"),
        created.alias("created_ms"),
        F.length("props").cast("long").alias("bytes"),
        root.alias("root"),
        gen.alias("gen"),
        "event_id",
        "user_id",
        "value",
    )


CHANGE_LOG = """
change_log AS (
  SELECT 'shard-' || (user_id % 4) || '-g' || least(2, CAST(floor((day(ts) - 1) / 10) AS INT)) AS shard_id, CAST(event_id AS VARCHAR) AS seq,
    CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'REMOVE' ELSE 'MODIFY' END AS event_name,
    'k' || user_id AS pk, epoch_us(ts) // 1000 AS created_ms, CAST(length(props) AS BIGINT) AS bytes,
    user_id % 4 AS root, least(2, CAST(floor((day(ts) - 1) / 10) AS INT)) AS gen, event_id, user_id, value
  FROM events
)"""


def raw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue in pages: each shard twice, the second time without its parent, and shards whose parents are gone."""
    nodes = change_log(spark, sf_dir).select(F.col("root").cast("int").alias("root"), "gen").distinct()
    name = lambda g: F.concat(F.lit("shard-"), F.col("root").cast("string"), F.lit("-g"), g.cast("string"))
    none = F.lit(None).cast("string")
    first = nodes.select(name(F.col("gen")).alias("shard_id"), F.when(F.col("gen") > 0, name(F.col("gen") - 1)).alias("parent_shard_id"), F.when(F.col("root") % 2 == 1, F.concat(F.lit("e"), F.col("gen").cast("string"))).alias("ending_sequence_number"), F.col("gen").alias("page"), F.col("root").alias("pos"))
    again = nodes.select(name(F.col("gen")).alias("shard_id"), none.alias("parent_shard_id"), F.lit("late").alias("ending_sequence_number"), (F.col("gen") + 1).alias("page"), (F.col("root") + 10).alias("pos"))
    roots = nodes.select("root").distinct()
    trimmed = roots.select(F.concat(F.lit("shard-t"), F.col("root").cast("string")).alias("shard_id"), F.concat(F.lit("shard-gone-"), F.col("root").cast("string")).alias("parent_shard_id"), none.alias("ending_sequence_number"), F.lit(9).alias("page"), F.col("root").alias("pos"))
    return first.unionByName(again).unionByName(trimmed)


RAW_SHARDS = (
    CHANGE_LOG
    + """,
nodes AS (SELECT DISTINCT CAST(root AS INT) AS root, gen FROM change_log),
raw_shards AS (
  SELECT 'shard-' || root || '-g' || gen AS shard_id, CASE WHEN gen > 0 THEN 'shard-' || root || '-g' || (gen - 1) END AS parent_shard_id,
    CASE WHEN root % 2 = 1 THEN 'e' || gen END AS ending_sequence_number, gen AS page, root AS pos FROM nodes
  UNION ALL SELECT 'shard-' || root || '-g' || gen, NULL, 'late', gen + 1, root + 10 FROM nodes
  UNION ALL SELECT 'shard-t' || root, 'shard-gone-' || root, NULL, 9, root FROM (SELECT DISTINCT root FROM nodes)
),
first_seen AS (SELECT shard_id, parent_shard_id, ending_sequence_number, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY page, pos) AS k FROM raw_shards) WHERE k = 1)"""
)


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage graph with, for each pair of roots, a shard merged from their last generations.

    Written once: operators read it several times, and a catalogue is small beside the log that it is derived from.
    """
    from millrace.operators.lineage import shard_graph
    from millrace.session import written

    nodes = change_log(spark, sf_dir).groupBy(F.col("root").cast("int").alias("root")).agg(F.max("gen").alias("gen"))
    name = F.concat(F.lit("shard-"), F.col("root").cast("string"), F.lit("-g"), F.col("gen").cast("string"))
    merged = nodes.groupBy(F.expr("root div 2").alias("pair")).agg(F.sort_array(F.collect_list(name)).alias("parents")).select(F.concat(F.lit("shard-m"), F.col("pair").cast("string")).alias("id"), "parents")
    return written(shard_graph(raw_shards(spark, sf_dir)).unionByName(merged), "shards")


SHARDS = (
    RAW_SHARDS
    + """,
links AS (
  SELECT f.shard_id AS id, f.parent_shard_id AS parent FROM first_seen f WHERE f.parent_shard_id IN (SELECT shard_id FROM first_seen)
  UNION ALL SELECT 'shard-m' || (root // 2), 'shard-' || root || '-g' || max(gen) FROM nodes GROUP BY root
),
shards AS (SELECT shard_id AS id FROM first_seen UNION ALL SELECT DISTINCT 'shard-m' || (root // 2) FROM nodes)"""
)


def shard_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases of the lineage's shards but the trimmed ones and one more, and rows of heartbeats and the leader."""
    graph = shards(spark, sf_dir).where("id not like 'shard-t%' and id <> 'shard-3-g2'")
    gen = F.regexp_extract("id", "-g([0-9]+)$", 1)
    root = F.regexp_extract("id", "^shard-([0-9]+)-", 1)
    done = (gen == "0") | ((gen == "1") & root.isin("0", "2"))
    checkpoint = F.when(root == "0", F.lit(None).cast("string")).when(root == "1", "LATEST").when(root != "", F.concat(F.lit("9"), gen))
    rows = graph.select(F.col("id").alias("lease_key"), F.concat(F.lit("w"), F.when(root == "", "0").otherwise(root)).alias("owner"), F.lit(1).cast("long").alias("counter"), checkpoint.alias("checkpoint"), done.alias("completed"), "parents")
    pseudo = spark.createDataFrame([("__hb__:w0", "w0", 7, None, False, []), ("__shard_sync_leader__", "w1", 3, None, False, [])], rows.schema)
    return rows.unionByName(pseudo)


SHARD_LEASES = (
    SHARDS
    + """,
shard_leases AS (
  SELECT id AS lease_key, 'w' || CASE WHEN root = '' THEN '0' ELSE root END AS owner,
    CASE WHEN root = '0' THEN NULL WHEN root = '1' THEN 'LATEST' WHEN root <> '' THEN '9' || gen END AS checkpoint,
    gen = '0' OR (gen = '1' AND root IN ('0', '2')) AS completed
  FROM (SELECT id, regexp_extract(id, '-g([0-9]+)$', 1) AS gen, regexp_extract(id, '^shard-([0-9]+)-', 1) AS root FROM shards)
  WHERE id NOT LIKE 'shard-t%' AND id <> 'shard-3-g2'
)"""
)


def leases(spark: SparkSession, sf_dir: str, skewed: bool = False) -> DataFrame:
    """A balanced lease table, or one in which few workers hold most."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    if skewed:
        owner = F.when(k % 50 == 0, F.lit(None).cast("string")).when(k % 10 < 6, "w0").when(k % 10 < 9, "w1").otherwise("w2")
        expired = (F.col("c_mktsegment") == "BUILDING") & owner.isNotNull() & (k % 10 == 1)
    else:
        owner = F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("w"), (F.col("c_nationkey") % 3).cast("string")))
        expired = (F.col("c_mktsegment") == "BUILDING") & owner.isNotNull()
    return c.select(F.lpad(k.cast("string"), 9, "0").alias("lease_key"), owner.alias("owner"), expired.alias("expired"), (F.col("c_acctbal") < 0).alias("completed"), (k % 5).alias("counter"))


LEASES = """
leases AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS lease_key, CASE WHEN c_custkey % 7 <> 0 THEN 'w' || (c_nationkey % 3) END AS owner,
    c_mktsegment = 'BUILDING' AND c_custkey % 7 <> 0 AS expired, c_acctbal < 0 AS completed, c_custkey % 5 AS counter
  FROM customer
)"""
LEASES_SKEWED = """
leases AS (
  SELECT *, c_mktsegment = 'BUILDING' AND owner IS NOT NULL AND k % 10 = 1 AS expired
  FROM (
    SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS lease_key, c_custkey AS k, c_mktsegment, c_acctbal < 0 AS completed, c_custkey % 5 AS counter,
      CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 10 < 6 THEN 'w0' WHEN c_custkey % 10 < 9 THEN 'w1' ELSE 'w2' END AS owner
    FROM customer
  )
)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of workers' heartbeat counters."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("w"), F.col("o_orderkey").alias("now_ms"), (F.col("o_orderstatus") == "F").cast("long").alias("beat"))
    count = F.sum("beat").over(Window.partitionBy("w").orderBy("now_ms").rowsBetween(Window.unboundedPreceding, 0))
    return o.select(F.concat(F.lit("w"), F.col("w").cast("string")).alias("worker"), "now_ms", count.alias("counter"))


SNAPSHOTS = """
snapshots AS (
  SELECT 'w' || (o_custkey % 5) AS worker, o_orderkey AS now_ms,
    CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter
  FROM orders
)"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint per shard: a token that it holds, none, LATEST, or one that it does not hold."""
    log = change_log(spark, sf_dir)
    middle = log.groupBy("shard_id", "root").agg(F.expr("(min(event_id) + max(event_id)) div 2").alias("m"))
    held = log.join(middle, ["shard_id", "root"]).where("event_id <= m").groupBy("shard_id", "root").agg(F.max("event_id").cast("string").alias("token"))
    cp = F.when(F.col("root") == 1, F.lit(None).cast("string")).when(F.col("root") == 2, F.when(F.endswith("shard_id", F.lit("g1")), "LATEST").otherwise("0x")).otherwise(F.col("token"))
    return held.select("shard_id", cp.alias("checkpoint"))


CHECKPOINTS = (
    CHANGE_LOG
    + """,
middle AS (SELECT shard_id, root, (min(event_id) + max(event_id)) // 2 AS m FROM change_log GROUP BY shard_id, root),
checkpoints AS (
  SELECT shard_id, CASE root WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN ends_with(shard_id, 'g1') THEN 'LATEST' ELSE '0x' END ELSE token END AS checkpoint
  FROM (SELECT c.shard_id, c.root, CAST(max(event_id) AS VARCHAR) AS token FROM change_log c JOIN middle m ON c.shard_id = m.shard_id WHERE event_id <= m.m GROUP BY ALL)
)"""
)


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements: one per shard and creation time."""
    log = change_log(spark, sf_dir)
    return log.groupBy("shard_id", F.col("created_ms").alias("at_ms")).agg(F.max("event_id").cast("string").alias("seq"))


ACKS = CHANGE_LOG + ", acks AS (SELECT shard_id, created_ms AS at_ms, CAST(max(event_id) AS VARCHAR) AS seq FROM change_log GROUP BY ALL)"
