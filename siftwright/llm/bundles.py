"""Problem 5: splits that keep related records together.

Groups are tied when rows of both share a source. The graph has one vertex per
group; a source with several groups ties each of them to its smallest one, so a
source with one group, the common case, leaves no edge at all.

Components come from a breadth-first search of many seeds at once. Seeds are
the vertices whose hash is the lowest among their neighbours, so each component
has one at least and every other vertex has a path of falling hashes to one:
the search ends after few steps however large a component is. Adjacency is
hash-partitioned by vertex once, when it is written; a step brings the frontier,
the vertices labelled in the step before, to it and shuffles what it reaches.
The neighbours of a frontier are in it, in the one before or new, so only these
two are looked at to tell. Seeds that meet within a component are merged in the
graph of their labels, which has one edge per pair of labels that touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.llm.common import BUCKET_DIGITS, fold, hash_hex
from siftwright.llm.components import contract, number_vertices
from siftwright.session import Scratch, read_table

#: Name and share of each split, in the order in which hash order fills them.
PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
SEED = "bundles-1"
MAX_STEPS = 500


def grow(edges: DataFrame, scratch: Scratch, seed: int = 29) -> DataFrame:
    """``(v, root)`` of every vertex of ``edges (a bigint, b bigint)``, by search from many seeds.

    ``root`` is some vertex of v's component, the same for all of it. Self
    loops and repeated edges are ignored; no edges give no rows.
    """
    order = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("v"))
    links = edges.where("a <> b")
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    adjacency = scratch.cut_by(links.select("a", "b").union(links.select("b", "a")).distinct(), "a", buckets)
    nearest = adjacency.groupBy("a").agg(F.min(order("b")).alias("best"))
    seeds = nearest.where(order("a") < F.col("best")).select(F.col("a").alias("v"), F.col("a").alias("label"))
    frontier = scratch.cut(seeds)
    labels, recent = frontier, frontier
    for _ in range(MAX_STEPS):
        if frontier.isEmpty():
            break
        step = adjacency.join(frontier.withColumnRenamed("v", "a"), "a").groupBy("b").agg(F.min("label").alias("label"))
        fresh = step.withColumnRenamed("b", "v").join(recent.select("v"), "v", "left_anti")
        before, frontier = frontier, scratch.cut(fresh.select("v", "label"))
        labels, recent = labels.unionByName(frontier), before.unionByName(frontier)
    else:
        raise RuntimeError(f"vertices not reached after {MAX_STEPS} steps")
    labels = scratch.cut(labels)
    touching = (
        adjacency.where("a < b")
        .join(labels.select(F.col("v").alias("a"), F.col("label").alias("x")), "a")
        .join(labels.select(F.col("v").alias("b"), F.col("label").alias("y")), "b")
        .where("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    merged = contract(touching, scratch, seed + 1).select(F.col("v").alias("label"), "root")
    scratch.drop(adjacency)
    return labels.join(merged, "label", "left").select("v", F.coalesce("root", "label").alias("root"))


def tie_groups(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """``(group_id, bundle_id)`` of every folded group tied to at least one other.

    ``rows (group_id, source_id)``. Rows with a null group or source tie nothing; a blank one is a value like
    any other. ``bundle_id`` is the smallest folded group of the bundle.
    """
    return tie_folded(rows.select(fold("group_id").alias("g"), fold("source_id").alias("s")), spark)


def tie_folded(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """``tie_groups`` of ``rows (g, s)`` that are folded already."""
    scratch = Scratch(spark, "bundles")
    held = scratch.cut(rows.select("g", "s").where("g is not null and s is not null").distinct())
    first = held.groupBy("s").agg(F.min("g").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "m")
    ties = scratch.cut(held.join(first, "s").where("g <> m").select("m", "g").distinct())
    scratch.drop(held)
    vertices, seed = number_vertices(ties.select(F.col("m").alias("name")).union(ties.select("g")), scratch)
    number = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    roots = grow(ties.select(number("m").alias("a"), number("g").alias("b")), scratch)
    named = scratch.cut(roots.join(vertices, "v").select("root", F.col("name").alias("group_id")))
    scratch.drop(ties)
    smallest = named.groupBy("root").agg(F.min("group_id").alias("bundle_id"))
    return named.join(smallest, "root").select("group_id", "bundle_id")


def split_bundles(weights: DataFrame, proportions=PROPORTIONS, seed: str = SEED) -> DataFrame:
    """``(bundle, n, split)`` from ``weights (bundle, n)``, filling the splits in hash order.

    Bundles stand in the order of their hash; each goes to the split in which
    the middle of its rows falls. Running totals come from bucket totals and a
    running total within the bucket, so no task sees all bundles.
    """
    rows = weights.withColumn("h", hash_hex(seed, F.col("bundle")))
    rows = rows.withColumn("_bucket", F.substring("h", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("_bucket").agg(F.sum("n").alias("_n"))  # at most 16**BUCKET_DIGITS rows
    everything = Window.partitionBy(F.lit(0))
    starts = buckets.select(
        "_bucket", (F.sum("_n").over(everything.orderBy("_bucket")) - F.col("_n")).alias("_start"), F.sum("_n").over(everything).alias("_all")
    )
    inside = F.sum("n").over(Window.partitionBy("_bucket").orderBy("h", "bundle")) - F.col("n") / 2
    middle = (F.col("_start") + F.col("_inside")) / F.col("_all")
    edge, split = 0.0, F.lit(proportions[-1][0])
    bounds = []
    for name, share in proportions[:-1]:
        edge += share
        bounds.append((name, edge))
    for name, edge in reversed(bounds):
        split = F.when(F.col("_middle") < F.lit(edge), F.lit(name)).otherwise(split)
    return (
        rows.withColumn("_inside", inside).join(F.broadcast(starts), "_bucket")
        .withColumn("_middle", middle).select("bundle", "n", split.alias("split"))
    )


def assign(rows: DataFrame, spark: SparkSession, proportions=PROPORTIONS, seed: str = SEED) -> DataFrame:
    """``(id, bundle, split)`` of every row: rows of one bundle share a split.

    A row belongs to the bundle of its group; a row without a group follows the
    groups that share its source, else its source alone, else itself. Repeated
    deliveries of an id under the same keys count once.
    """
    scratch = Scratch(spark, "splits")
    keyed = rows.where("id is not null").select("id", fold("group_id").alias("g"), fold("source_id").alias("s")).distinct()
    keyed = scratch.cut(keyed)
    ties = scratch.cut(tie_folded(keyed, spark))  # the source is read and folded once
    bundle_of = keyed.where("g is not null").join(ties.withColumnRenamed("group_id", "g"), "g", "left").select(
        "id", "g", "s", F.concat(F.lit("group\x1f"), F.coalesce("bundle_id", "g")).alias("bundle")
    )
    by_source = bundle_of.where("s is not null").groupBy("s").agg(F.min("bundle").alias("b"))
    loose = keyed.where("g is null").join(by_source, "s", "left").select(
        "id", "g", "s",
        F.coalesce("b", F.concat(F.lit("source\x1f"), F.col("s")), F.concat(F.lit("row\x1f"), F.col("id"))).alias("bundle"),
    )
    placed = scratch.cut(bundle_of.unionByName(loose).select("id", "bundle").distinct())
    splits = split_bundles(placed.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")), proportions, seed)
    return placed.join(splits.select("bundle", "split"), "bundle").select("id", "bundle", "split")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tie_groups(read_table(spark, sf_dir, "zagreus_scaled_kd_data").select("group_id", "source_id"), spark)


P5_SQL = r"""
with recursive h as (select distinct lower(regexp_replace(group_id, '^\s+|\s+$', '', 'g')) g, lower(regexp_replace(source_id, '^\s+|\s+$', '', 'g')) s
  from zagreus_scaled_kd_data where group_id is not null and source_id is not null),
f as (select s, min(g) m from h group by s having count(*) > 1),
t as (select distinct m, g from h join f using (s) where g <> m),
e as (select m x, g y from t union select g, m from t),
walk(g, root) as (select x, x from e union select e.y, w.root from walk w join e on e.x = w.g)
select g as group_id, min(root) as bundle_id from walk group by g
"""


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "zagreus_scaled_kd_data").select("id", "group_id", "source_id"), spark)


def p5_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bundles of each split."""
    return p5_splits(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("bundle").alias("bundles")
    )
