"""Validating predicates and reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.arrays import total
from siftwright.functions.text import norm_keep


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def four_distinct_options(options: Column, gold: Column) -> Column:
    """Four options, none blank, distinct in normal form, and a gold index among them."""
    keyed = F.transform(options, norm_keep)
    ok = (F.size(options) == 4) & (F.size(F.array_distinct(keyed)) == 4) & ~F.exists(keyed, lambda o: o == "") & gold.between(0, 3)
    return F.coalesce(ok, F.lit(False))


def item_reasons() -> list[tuple[str, Column]]:
    """Reason and predicate of each structural fault of an item row."""
    size = F.coalesce(F.size("options"), F.lit(-1))
    keyed = F.transform("options", norm_keep)
    return [
        ("missing_group", blank(F.col("group_id"))),
        ("missing_domain", blank(F.col("domain"))),
        ("missing_question", blank(F.col("question"))),
        ("option_count", size != 4),
        ("empty_option", F.coalesce(F.exists(keyed, lambda o: o == ""), F.lit(False))),
        ("repeated_option", F.coalesce(F.size(F.array_distinct(keyed)) < F.size(keyed), F.lit(False))),
        ("gold_out_of_range", ~F.coalesce(F.col("gold").between(0, 3), F.lit(False))),
    ]


def with_reasons(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reasons``, the array of all that hold, in rule order."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(p, F.lit(r)) for r, p in reasons])))


def quarantine(rows: DataFrame, reasons: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the reasons column, and rejected rows with it."""
    marked = with_reasons(rows, reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def reason_counts(rejected: DataFrame, first_only: bool = False) -> DataFrame:
    """Rows per reason: each reason of a row, or its first one only."""
    each = F.slice("reasons", 1, 1) if first_only else F.col("reasons")
    return rejected.select(F.explode(each).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def denied(columns: list[Column], terms: list[str], prefixes: list[str]) -> Column:
    """Whether any column equals a denied term or starts with a denied prefix, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        low = F.lower(F.coalesce(c, F.lit("")))
        for t in terms:
            hit = hit | (low == t)
        for p in prefixes:
            hit = hit | low.startswith(p)
    return hit


def posterior_ok(p: Column, size: int = 4, tolerance: float = 1e-5) -> Column:
    return F.coalesce((F.size(p) == size) & (F.abs(total(p) - 1) <= tolerance) & ~F.exists(p, lambda x: (x < 0) | F.isnan(x.cast("double"))), F.lit(False))


def order_ok(order: Column, size: int = 4) -> Column:
    return F.coalesce(F.array_sort(order) == F.sequence(F.lit(0), F.lit(size - 1)), F.lit(False))


def triggers(*kinds: tuple[str, Column, Column]) -> Column:
    """Array of ``(kind, score)`` of the screens that fire, in order: kind, predicate, score."""
    return F.array_compact(F.array(*[F.when(p, F.struct(F.lit(k).alias("kind"), s.cast("double").alias("score"))) for k, p, s in kinds]))


def eligible(tops: Column, gold: Column, p_gold: Column, votes: int = 3, floor: float = 0.35) -> Column:
    """Enough views pick the gold option and its mean probability is high enough."""
    return (F.size(F.filter(tops, lambda x: x == gold)) >= votes) & (p_gold >= floor)


def authorised(rows: DataFrame) -> DataFrame:
    """Rows whose gold label may be trained on."""
    return rows.where("gold_ce_authorized and campaign_gold is not null")


def anchor_rows(rows: DataFrame) -> Column:
    return F.coalesce(F.col("anchor_replay"), F.col("source_split") == "unassigned", F.lit(False))


def remove_families(rows: DataFrame, bad: DataFrame, key: str = "group_id") -> DataFrame:
    """Rows of families none of whose members is in ``bad``."""
    return rows.join(bad.select(key).distinct(), key, "left_anti")
