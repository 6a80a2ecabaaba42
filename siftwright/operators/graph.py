"""Connected components by alternating large and small stars.

Large star: every vertex links its greater neighbours to the least vertex
around it; small star: it links its lesser neighbours and itself to that one.
Alternating both, each component becomes a star around its least vertex in a
logarithmic number of rounds. Every round is an aggregation and a join on the
vertex; the pre-aggregated minimum has one row per vertex, so a hub with a
large share of all edges is split by adaptive execution instead of gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.session import Scratch

MAX_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """``(id, root)`` of every vertex of ``edges (a, b)``; ``root`` is the least id of its component.

    Nulls and self loops link nothing; vertices without an edge do not come out.
    """
    scratch = Scratch(spark, "stars")
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        grown = scratch.cut(_large(now))
        after = scratch.cut(_small(grown))
        scratch.drop(now, grown)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def family_ids(members: DataFrame, components: DataFrame) -> DataFrame:
    """``(id, group_id)``: a content hash of the ids of the component; lone ids are families of one.

    A hash of hashes: ids fall into buckets by their own hash, each bucket's
    sorted list is hashed, and the bucket hashes in order give the family's. So
    no row holds a whole family, whatever its size.
    """
    from siftwright.functions.keys import family_id

    placed = members.join(components, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    name = F.col("id").cast("string")
    parts = placed.groupBy("root", F.substring(F.sha2(name, 256), 1, 3).alias("bucket")).agg(family_id(F.collect_list(name)).alias("part"))
    whole = parts.groupBy("root").agg(family_id(F.collect_list(F.concat("bucket", "part"))).alias("group_id"))  # 4096 buckets at most
    return placed.join(whole, "root").select("id", "group_id")
