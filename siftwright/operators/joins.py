"""Keyed joins: membership, exclusion, lookups, overlays and conservation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.keys import hash_int, order_key


def member_of(rows: DataFrame, keys: DataFrame, key: str, keep: bool = True) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def exclude_any(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share no key with ``excluded``: any one of ``keys`` excludes; nulls exclude nothing."""
    for k in keys:
        rows = rows.join(excluded.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return rows.select(rows.columns)


def lookup_last(rows: DataFrame, reference: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Inner lookup; of reference rows with one key the last by ``order`` counts."""
    last = reference.groupBy(key).agg(F.max(F.struct(order, value))[value].alias(value))
    return rows.join(last, key)


def overlay(rows: DataFrame, decisions: DataFrame, keys: list[str], column: str, default: str) -> DataFrame:
    """Left join of a decision column with a default for undecided rows."""
    return rows.join(decisions.select(*keys, column), keys, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def conservation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: keys lost, keys gained, keys repeated on either side."""
    a = before.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = after.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("a").isNull()).alias("gained"),
        F.count_if((F.coalesce("a", F.lit(1)) > 1) | (F.coalesce("b", F.lit(1)) > 1)).alias("repeated"),
    )


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per domain: paired rows, gains, losses and accuracy delta of ``b`` over ``a`` (``id, domain, correct``)."""
    both = a.join(b.select("id", F.col("correct").alias("other")), "id")
    return both.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct") & F.col("other")).alias("gains"),
        F.count_if(F.col("correct") & ~F.col("other")).alias("losses"),
        (F.avg(F.col("other").cast("double")) - F.avg(F.col("correct").cast("double"))).alias("delta"),
    )


def circular_donor(rows: DataFrame, donors: DataFrame, salt: str) -> DataFrame:
    """``(id, donor_id)``: from a hashed start, the first donor round the circle of another group.

    ``rows (id, group_id)``, ``donors (donor_id, donor_group)``. Donors are
    numbered in id order; where the start falls into a run of the row's own
    group, the answer is the start of the next run, so one lookup of the
    position and one of the run's end replace the walk.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("donor_id")  # a pool of bounded size: its ids are numbered in one task
    placed = donors.select("donor_id", "donor_group", (F.row_number().over(order) - 1).alias("at"))
    n = placed.count()
    if n == 0:
        return rows.select("id", F.lit(None).cast(dict(donors.dtypes)["donor_id"]).alias("donor_id")).limit(0)
    changed = placed.withColumn("new", (F.col("donor_group") != F.lag("donor_group").over(order)) | F.lag("donor_group").over(order).isNull())
    runs = changed.withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    ends = runs.groupBy("run").agg(F.max("at").alias("end"))
    table = runs.join(ends, "run").select("at", "donor_id", "donor_group", ((F.col("end") + 1) % n).alias("next"))
    start = rows.withColumn("at", (hash_int(order_key(salt, F.col("id"))) % n).cast("int"))
    first = start.join(table, "at")
    ok = first.where(F.coalesce(F.col("donor_group") != F.col("group_id"), F.lit(True))).select("id", "donor_id")
    again = first.where(F.col("donor_group") == F.col("group_id")).select("id", "group_id", F.col("next").alias("at")).join(table, "at")
    # neighbouring runs differ in group; only a circle of one run wraps to itself, and the last run may meet the first
    wrapped = again.where(F.col("donor_group") == F.col("group_id")).select("id", "group_id", F.col("next").alias("at")).join(table, "at")
    return ok.unionByName(again.where(F.coalesce(F.col("donor_group") != F.col("group_id"), F.lit(True))).select("id", "donor_id")).unionByName(
        wrapped.where(F.col("donor_group") != F.col("group_id")).select("id", "donor_id")
    )


def peers(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each distinct value its key's other values, sorted."""
    pool = rows.groupBy(*key).agg(F.collect_set(value).alias("pool"))
    return rows.select(*key, value).distinct().join(pool, key).withColumn(
        "peers", F.array_sort(F.array_except("pool", F.array(F.col(value))))
    ).drop("pool")


def split_overlap(rows: DataFrame, key: Column | str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split, with the splits."""
    k = F.col(key) if isinstance(key, str) else key
    return rows.where(k.isNotNull()).groupBy(k.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def first_exclusion(rows: DataFrame, excluded: DataFrame, reasons: dict[str, str], kept: str = "kept") -> DataFrame:
    """``rows`` with ``reason``: the first of ``reasons (name -> key column)`` whose key ``excluded`` has, else ``kept``.

    One marking join per key on distinct keys; a null key excludes nothing.
    """
    columns, reason = rows.columns, F.lit(kept)
    for name, key in reversed(reasons.items()):
        known = excluded.where(F.col(key).isNotNull()).select(key).distinct().withColumn(f"_{name}", F.lit(True))
        rows = rows.join(known, key, "left")
        reason = F.when(F.col(f"_{name}"), name).otherwise(reason)
    return rows.select(*columns, reason.alias("reason"))


def leaking_keys(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``(split, groups, leaking)``: keys of each split and those of them that stand in another split too."""
    once = rows.select(key, split).distinct()
    spread = once.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return once.join(spread, key).groupBy(split).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("leaking"))


def attach_one(rows: DataFrame, attached: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the one row of ``attached`` of the same ``key``.

    Nothing is dropped: ``attached_rows`` counts what was there (it must be 1),
    ``same_order`` tells whether ``order`` agrees on both sides; without exactly
    one row the columns are null. ``covered`` of the result decides whether a
    stage may go on.
    """
    one = attached.groupBy(key).agg(F.count(F.lit(1)).alias("attached_rows"), F.min(F.struct(order, *columns)).alias("_a"))
    joined = rows.join(one, key, "left")
    single = F.coalesce(F.col("attached_rows"), F.lit(0)) == 1
    return joined.select(
        *rows.columns, F.coalesce("attached_rows", F.lit(0)).alias("attached_rows"), F.coalesce(single & (F.col("_a")[order] == F.col(order)), F.lit(False)).alias("same_order"),
        *[F.when(single, F.col("_a")[c]).alias(c) for c in columns],
    )


def covered(attached: DataFrame) -> DataFrame:
    """One row: rows, rows without exactly one attached, rows whose orders differ, and whether all is well."""
    wrong, other = F.count_if(F.col("attached_rows") != 1), F.count_if((F.col("attached_rows") == 1) & ~F.col("same_order"))
    return attached.agg(F.count(F.lit(1)).alias("rows"), wrong.alias("not_one"), other.alias("other_order"), ((wrong + other) == 0).alias("passed"))


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not worked on yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
