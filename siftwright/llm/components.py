"""Problem 2: pairwise matches to groups by random contraction of the graph.

Each round every vertex hooks to the vertex of lowest hash among itself and its
neighbours, under an order drawn afresh for the round; edges are relabelled and
deduplicated and the round's mapping is kept. A constant share of the vertices
is expected to vanish in each round, whatever the shape of the graph, so chains
of any length take a logarithmic number of rounds. When no edge is left, the
mappings are expanded backwards.

Each round aggregates and joins on vertex keys only: a vertex with a huge
number of neighbours is pre-aggregated before the shuffle, and the relabelling
joins have one row per vertex on one side, which adaptive execution splits when
the other side is skewed. Every round is cut by a table in the shared folder,
so a lost executor costs one round at most, and old tables are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import fold
from siftwright.session import Scratch, read_table

#: Contraction needs a logarithmic number of rounds; this only stops a defect.
MAX_ROUNDS = 200


def contract(edges: DataFrame, scratch: Scratch, seed: int = 17) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges (a bigint, b bigint)``.

    ``root`` is some vertex of v's component, the same for all of it. Self
    loops and repeated edges are ignored; nulls on either end link nothing; no
    edges give no rows.
    """
    def undirected(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(a) != F.col(b)).select(
            F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
        ).distinct()

    graph = scratch.cut(undirected(edges, "a", "b"))
    maps: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        if graph.isEmpty():
            break
        order = lambda c: F.xxhash64(F.lit(seed + turn), F.col(c))
        both = graph.select("a", "b").union(graph.select(F.col("b"), F.col("a")))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("v"))).alias("best"))
        hook = scratch.cut(best.select(
            F.col("a").alias("v"),
            F.least(F.col("best"), F.struct(order("a").alias("h"), F.col("a").alias("v")))["v"].alias("r"),
        ))
        maps.append(hook)
        left = hook.select(F.col("v").alias("a"), F.col("r").alias("ra"))
        right = hook.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        smaller = scratch.cut(undirected(graph.join(left, "a").join(right, "b"), "ra", "rb"))
        scratch.drop(graph)
        graph = smaller
    else:
        raise RuntimeError(f"edges left after {MAX_ROUNDS} rounds")
    scratch.drop(graph)
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)
    table, found = maps[-1], maps[-1].select("v", F.col("r").alias("root"))
    for hook in reversed(maps[:-1]):
        later = found.select(F.col("v").alias("r"), "root")
        found = scratch.cut(hook.join(later, "r", "left").select("v", F.coalesce("root", "r").alias("root")))
        scratch.drop(hook, table)
        table = found
    return found


def number_vertices(ends: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(v bigint, name)`` for the distinct ``name`` of ``ends`` and the hash seed used.

    A vertex is a 64-bit hash of its name. Names that collide are detected in
    the same aggregation and hashed again under another seed, so the numbering
    is exact.
    """
    for seed in range(1, 50):
        table = scratch.cut(ends.groupBy(F.xxhash64(F.lit(seed), F.col("name")).alias("v")).agg(
            F.min("name").alias("name"), F.max("name").alias("other")
        ))
        if table.where(F.col("name") != F.col("other")).isEmpty():
            return table.select("v", "name"), seed
        scratch.drop(table)
    raise RuntimeError("no hash seed without collisions")


def consolidate(pairs: DataFrame, names: DataFrame, spark: SparkSession) -> DataFrame:
    """``(id, root_id)``: every record linked with at least one other record.

    ``pairs (left_id, right_id)`` are accepted matches, ``names (id)`` the known
    records. Ends are compared trimmed and lower-cased and returned as ``names``
    writes them; should several records share a folded form, all are listed.
    Null ends, blank or unknown ends and self pairs link nothing. ``root_id`` is
    the smallest id of the group by code point.
    """
    scratch = Scratch(spark, "consolidate")
    known = names.where(F.col("id").isNotNull()).select(fold("id").alias("name"), "id").distinct()
    links = pairs.select(fold("left_id").alias("x"), fold("right_id").alias("y"))
    links = links.where("x is not null and y is not null and x <> y and x <> '' and y <> ''")
    links = links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    in_bank = known.select("name").distinct()
    links = links.join(in_bank.withColumnRenamed("name", "x"), "x", "left_semi")
    links = links.join(in_bank.withColumnRenamed("name", "y"), "y", "left_semi")
    links = scratch.cut(links)
    vertices, seed = number_vertices(links.select(F.col("x").alias("name")).union(links.select("y")), scratch)
    number = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    roots = contract(links.select(number("x").alias("a"), number("y").alias("b")), scratch)
    written = roots.join(vertices, "v").join(known, "name").select("root", "id")
    written = scratch.cut(written)
    smallest = written.groupBy("root").agg(F.min("id").alias("root_id"))
    return written.join(smallest, "root").select("id", "root_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_table(spark, sf_dir, "exam_match_pairs").where("verdict = 'match'")
    bank = read_table(spark, sf_dir, "zagreus_exam_bank_v1")
    return consolidate(pairs.select("left_id", "right_id"), bank.select("id"), spark)


P2_SQL = r"""
with recursive bank as (select distinct id, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) n from zagreus_exam_bank_v1 where id is not null),
p as (select lower(regexp_replace(left_id, '^\s+|\s+$', '', 'g')) x, lower(regexp_replace(right_id, '^\s+|\s+$', '', 'g')) y from exam_match_pairs where verdict = 'match'),
e as (select distinct x, y from p where x <> y and x in (select n from bank) and y in (select n from bank)),
s as (select x, y from e union select y, x from e),
walk(n, root) as (select x, x from s union select s.y, w.root from walk w join s on s.x = w.n),
g as (select n, min(root) root from walk group by n),
m as (select id, root from g join bank using (n))
select id, min(id) over (partition by root) as root_id from m
"""
P2_SIZES_SQL = f"with r as ({P2_SQL}), c as (select root_id, count(*) members from r group by root_id) select members, count(*) as groups from c group by members"


def p2_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of each size the accepted matches form."""
    groups = p2_found(spark, sf_dir).groupBy("root_id").agg(F.count(F.lit(1)).alias("members"))
    return groups.groupBy("members").agg(F.count(F.lit(1)).alias("groups"))
