"""Shard lineage as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.positions import child_seed, is_pseudo, start_mode
from millrace.schema import CLOSED_BY_SYNC
from millrace.session import written


def first_seen(raw: DataFrame) -> DataFrame:
    """One row per shard, the first that the pages list. Rows without an id are left out."""
    first = F.min_by(F.struct("parent_shard_id", "ending_sequence_number", "page", "pos"), F.struct("page", "pos"))
    return raw.where("shard_id <> ''").groupBy("shard_id").agg(first.alias("row")).select("shard_id", "row.*")


def parents_of(raw: DataFrame) -> DataFrame:
    """(id, parents): a parent that the catalogue no longer lists is none."""
    known = raw.select(F.col("shard_id").alias("known")).distinct()
    joined = raw.join(known, raw["parent_shard_id"] == known["known"], "left")
    return joined.select(F.col("shard_id").alias("id"), F.when(F.col("known").isNotNull(), F.array("known")).otherwise(F.array().cast("array<string>")).alias("parents"))


def shard_graph(raw: DataFrame) -> DataFrame:
    """The lineage graph of listed pages."""
    return parents_of(first_seen(raw))


def merge_children(existing: DataFrame, discovered: DataFrame) -> DataFrame:
    """``existing`` and those of ``discovered`` (raw shards) that it lacks; parents may be in either."""
    new = first_seen(discovered).join(existing.select(F.col("id").alias("shard_id")), "shard_id", "left_anti")
    known = existing.select(F.col("id").alias("known")).unionByName(new.select(F.col("shard_id").alias("known")))
    linked = new.join(known, new["parent_shard_id"] == known["known"], "left")
    graph = linked.select(F.col("shard_id").alias("id"), F.when(F.col("known").isNotNull(), F.array("known")).otherwise(F.array().cast("array<string>")).alias("parents"))
    return existing.select("id", "parents").unionByName(graph)


def is_open(ending: Column) -> Column:
    return ending.isNull()


def close_open_parents(raw: DataFrame) -> DataFrame:
    """A shard that is open but has children gets the sentinel as its ending; a real ending stays."""
    parents = raw.where("parent_shard_id is not null").select(F.col("parent_shard_id").alias("shard_id"), F.lit(True).alias("has_child")).distinct()
    ending = F.when(is_open(F.col("ending_sequence_number")) & F.col("has_child"), CLOSED_BY_SYNC).otherwise(F.col("ending_sequence_number"))
    return raw.join(parents, "shard_id", "left").withColumn("ending_sequence_number", ending).drop("has_child")


def child_shards(raw: DataFrame, parent: str) -> DataFrame:
    """The filter that a source evaluates: raw children of one parent."""
    return raw.where(F.col("parent_shard_id") == parent)


def graph_from_leases(leases: DataFrame) -> DataFrame:
    """The lineage graph that followers read from the lease table."""
    return leases.where(~is_pseudo(F.col("lease_key"))).select(F.col("lease_key").alias("id"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


def _links(shards: DataFrame) -> DataFrame:
    return shards.select("id", F.explode("parents").alias("parent"))


def eligible(shards: DataFrame, completed: DataFrame, missing_blocks: bool = True) -> DataFrame:
    """Ids of shards that are not complete and whose parents all are. ``completed``: column id.

    With ``missing_blocks`` a parent that is no shard of the graph blocks; without, it counts as collected long ago.
    """
    links = _links(shards)
    if not missing_blocks:
        links = links.join(shards.select(F.col("id").alias("parent")), "parent", "left_semi")
    waiting = links.join(completed.select(F.col("id").alias("parent")), "parent", "left_anti").select("id")
    return shards.select("id").join(completed.select("id"), "id", "left_anti").join(waiting, "id", "left_anti")


def safe_to_delete(shards: DataFrame, state: DataFrame) -> DataFrame:
    """Ids of completed shards with children, each of which is processed or complete. ``state``: id, completed, processing."""
    done = state.where("completed").select(F.col("id").alias("parent"))
    begun = state.select("id", (F.col("processing") | F.col("completed")).alias("begun"))
    children = _links(shards).join(done, "parent", "left_semi").join(begun, "id", "left")
    return children.groupBy("parent").agg(F.bool_and(F.coalesce("begun", F.lit(False))).alias("safe")).where("safe").select(F.col("parent").alias("id"))


def cleanup_state(leases: DataFrame) -> DataFrame:
    """(id, completed, processing): a lease is processed if complete or checkpointed at a record."""
    begun = F.col("completed") | ~start_mode(F.col("checkpoint"))
    return leases.where(~is_pseudo(F.col("lease_key"))).select(F.col("lease_key").alias("id"), "completed", begun.alias("processing"))


def parent_checkpoints(shards: DataFrame, leases: DataFrame) -> DataFrame:
    """(id, checkpoints) of shards with parents; a parent without a lease gives null."""
    known = leases.select(F.col("lease_key").alias("parent"), "checkpoint")
    # collect_list leaves nulls out; a struct keeps them.
    rows = F.collect_list(F.struct("checkpoint"))
    return _links(shards).join(known, "parent", "left").groupBy("id").agg(F.transform(rows, lambda r: r["checkpoint"]).alias("checkpoints"))


def seeded_children(shards: DataFrame, leases: DataFrame) -> DataFrame:
    """(id, checkpoint) with which each shard's lease is created, from its parents' checkpoints."""
    found = shards.select("id").join(parent_checkpoints(shards, leases), "id", "left")
    return found.select("id", child_seed(F.coalesce("checkpoints", F.array().cast("array<string>"))).alias("checkpoint"))


def roots_to_seed(shards: DataFrame, leases: DataFrame, position: str | None) -> DataFrame:
    """(id, checkpoint) of eligible shards without a lease, at the initial position: what a leader inserts once."""
    completed = leases.where("completed").select(F.col("lease_key").alias("id"))
    existing = leases.select(F.col("lease_key").alias("id"))
    return eligible(shards, completed).join(existing, "id", "left_anti").withColumn("checkpoint", F.lit(position).cast("string"))


def parents_to_sync(leases: DataFrame, synced: DataFrame) -> DataFrame:
    """Ids of completed shards whose children are neither published nor asked for yet."""
    rows = leases.where(~is_pseudo(F.col("lease_key")))
    published = rows.select(F.explode("parents").alias("id"))
    return rows.where("completed").select(F.col("lease_key").alias("id")).join(published, "id", "left_anti").join(synced.select("id"), "id", "left_anti")


#: Links that the driver takes in to number generations by itself; larger graphs go level by level in Spark.
DRIVER_LINKS = 1_000_000


def generations(shards: DataFrame, most: int = DRIVER_LINKS) -> DataFrame:
    """(id, generation): roots are 0, a child comes one after its latest parent. Parents that are no shards do not count.

    Each link is looked at once per level at most, whatever the number of paths, and there is no limit of depth. A
    graph of at most ``most`` links is numbered on the driver, which checks that before it takes them.
    """
    ids = shards.select("id").distinct()
    links = _links(shards).distinct().join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    few = links.limit(most + 1).collect()
    if len(few) <= most:
        level = _numbered([(r["id"], r["parent"]) for r in few])
        known = shards.sparkSession.createDataFrame(list(level.items()), "id string, generation int")
        return ids.join(known, "id", "left").select("id", F.coalesce("generation", F.lit(0)).alias("generation"))
    links = written(links, "links")
    done = written(ids.join(links.select("id").distinct(), "id", "left_anti").withColumn("generation", F.lit(0)), "level")
    before, now, level = 0, done.count(), 0
    while now > before:
        # All children of the last level rise; what rises again later is overwritten by its greatest level.
        level += 1
        last = done.where(F.col("generation") == level - 1).select(F.col("id").alias("parent"))
        risen = links.join(last, "parent", "left_semi").select("id").distinct().withColumn("generation", F.lit(level))
        risen = written(risen, "level")
        before, now = 0, risen.count()
        done = written(done.unionByName(risen).groupBy("id").agg(F.max("generation").alias("generation")), "level")
        if level > DRIVER_LINKS:
            raise ValueError("a shard is its own ancestor")
    return done


def _numbered(links: list[tuple[str, str]]) -> dict[str, int]:
    """Generations of all ends of the links (child, parent), each shard after all its parents."""
    children: dict[str, list[str]] = {}
    waits: dict[str, int] = {}
    for child, parent in links:
        children.setdefault(parent, []).append(child)
        waits[child] = waits.get(child, 0) + 1
    level = {p: 0 for p in children if p not in waits}
    ready = list(level)
    for shard in ready:
        for child in children.get(shard, ()):
            level[child] = max(level.get(child, 0), level[shard] + 1)
            waits[child] -= 1
            if not waits[child]:
                ready.append(child)
    if any(waits.values()):
        raise ValueError(f"a shard is its own ancestor: {sorted(s for s, n in waits.items() if n)[:5]}")
    return level


def delivery_order(records: DataFrame, shards: DataFrame) -> DataFrame:
    """Records with their shard's generation and place in it: parents drain before children."""
    place = F.row_number().over(Window.partitionBy("shard_id").orderBy(F.length("seq"), "seq"))
    return records.join(generations(shards).withColumnRenamed("id", "shard_id"), "shard_id").withColumn("place", place)
