"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, shuffled, written

#: A node with more than this part of all rows is a hub: there are at most SHARE hubs, however many rows.
SHARE = 2000
#: Rows below which no node is a hub.
LEAST = 256


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(directed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, table to discard): for each u, link all its listed neighbours to the smallest of them and u itself.

    A hub's rows never meet in one task: its smallest neighbour comes from partial aggregates, and is broadcast with
    those of the other hubs (at most SHARE of them, by construction); only the other nodes are joined by a shuffle.
    """
    least = written(directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), "stars")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    limit = max(LEAST, -(-total // SHARE))
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    rest = directed.join(hubs.select("u"), "u", "left_anti").join(shuffled(least.where(F.col("n") <= limit).select("u", "m")), "u")
    return directed.join(hubs, "u").unionByName(rest), least


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(id, component): component is the smallest id that links reach. Nodes without a link are absent.

    Both steps aggregate before they join; the number of rounds grows with the
    logarithm of the longest path. Null ends are dropped, loops and repeated
    links are harmless, and an empty input gives an empty result.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    now = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now = written(now.distinct(), "edges")
    before = None
    while (state := _checksum(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star, spent = _star(both)
        large = written(star.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(now, spent)
        star, spent = _star(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        discard(large, spent)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
