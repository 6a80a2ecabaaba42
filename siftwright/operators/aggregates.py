"""Aggregates over items, predictions and posteriors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_and_by(rows: DataFrame, *levels: str) -> DataFrame:
    """Row counts in total and by each level on its own: grouping sets in one pass."""
    return rows.groupingSets([[], *[[x] for x in levels]], *levels).agg(F.count(F.lit(1)).alias("n"))


def generation_rates(rows: DataFrame) -> DataFrame:
    """Per domain the shares of ``correct``, ``valid``, ``exact`` and ``ended`` outputs (nulls left out of each)."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 9)
    return rows.groupBy("domain").agg(
        rate("correct").alias("accuracy"), rate("valid").alias("valid"), rate("exact").alias("exact"), rate("ended").alias("immediate_end")
    )


def teacher_summary(rows: DataFrame, votes: int = 3, floor: float = 0.35) -> DataFrame:
    """From ``rows (domain, gold, votes, m)``, one per item with its mean posterior ``m``: a row per domain and one in total."""
    p_gold = F.element_at("m", F.col("gold") + 1)
    ok = (F.col("votes") >= votes) & (p_gold >= floor)
    top = F.array_position("m", F.array_max("m")) - 1
    marked = rows.select("domain", ok.alias("ok"), (top == F.col("gold")).alias("right"), p_gold.alias("p_gold"))
    return marked.groupingSets([[], ["domain"]], "domain").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("ok").alias("eligible"), F.round(F.avg(F.col("ok").cast("double")), 9).alias("eligible_rate"),
        F.round(F.avg(F.col("right").cast("double")), 9).alias("ensemble_accuracy"), F.round(F.avg("p_gold"), 8).alias("mean_p_gold"),
    ).withColumn("domain", F.coalesce("domain", F.lit("")))


def word_index(rows: DataFrame, by: list[str], word: str, key: str) -> DataFrame:
    """One row per class and word: rows of ``key`` that hold it, and those it answers (``right``)."""
    return rows.groupBy(*by, word).agg(F.countDistinct(key).alias("items"), F.countDistinct(F.when(F.col("right"), F.col(key))).alias("right_in"))


def collapse(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``representatives (key, id, rows)`` and ``provenance``: every row with its representative ``rep``.

    The representative is the lowest id of its key. Provenance comes as rows,
    not as a list in the representative's row, which a large group would make
    unbounded. Rows with a null key are left out.
    """
    keyed = rows.where(F.col(key).isNotNull())
    reps = keyed.groupBy(key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    return reps, keyed.join(reps.select(key, F.col("id").alias("rep"), "rows"), key)


def key_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("values"), F.count(F.lit(1)).alias("rows")).where("values > 1")


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    """Number of groups of each size."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def macro_accuracy(predictions: DataFrame) -> DataFrame:
    """Mean over domains of the share correct, with the plain share."""
    by = predictions.groupBy("domain").agg(F.avg(F.col("correct").cast("double")).alias("acc"), F.count_if("correct").alias("c"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.avg("acc").alias("macro"), (F.sum("c") / F.sum("n")).alias("micro"), F.sum("n").alias("rows"))


def view_agreement(predictions: DataFrame) -> DataFrame:
    """Mean over rows of the share of view pairs that predict the same option."""
    votes = predictions.groupBy("id", "prediction").agg(F.count(F.lit(1)).alias("c"))
    per = votes.groupBy("id").agg((F.sum(F.col("c") * (F.col("c") - 1)) / (F.sum("c") * (F.sum("c") - 1))).alias("agree"), F.sum("c").alias("n"))
    return per.where("n > 1").agg(F.avg("agree").alias("agreement"), F.count(F.lit(1)).alias("rows"))


def letter_shares(predictions: DataFrame, letter: str = "prediction", kinds: int = 4) -> DataFrame:
    """Share of each predicted option, and its distance from uniform."""
    counts = predictions.where(F.col(letter).isNotNull()).groupBy(letter).agg(F.count(F.lit(1)).alias("n"))
    everything = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(everything)  # one row
    return shares.select(letter, "n", (F.col("n") / F.col("total")).alias("share"), F.abs(F.col("n") / F.col("total") - 1 / kinds).alias("off"))


def bootstrap_interval(pairs: DataFrame, samples: int = 1000, seed: int = 7, blocks: int = 8) -> DataFrame:
    """Domain-stratified paired bootstrap of the macro delta: estimate and 2.5 / 97.5 % quantiles.

    ``pairs (id, domain, delta)`` holds one difference per question. The
    differences of a domain are counted by value first (they take few values),
    so a replicate draws multinomial counts instead of rows, and blocks of
    replicates run in parallel on the counts alone.
    """
    counts = pairs.where("delta is not null").groupBy("domain", F.round("delta", 9).alias("delta")).agg(F.count(F.lit(1)).alias("n"))
    table = counts.groupBy(F.lit(0).alias("one")).agg(F.collect_list(F.struct("domain", "delta", "n")).alias("t"))
    jobs = pairs.sparkSession.range(blocks).withColumn("per", F.lit(-(-samples // blocks)))

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, per, t in zip(pdf["id"], pdf["per"], pdf["t"]):
            rng = np.random.default_rng([seed, int(block)])
            domains: dict[str, list] = {}
            for r in sorted(t, key=lambda r: (str(r["domain"]), r["delta"])):
                domains.setdefault(r["domain"], []).append((r["delta"], r["n"]))
            means = []
            for rows in domains.values():
                d, n = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
                means.append(rng.multinomial(n.sum(), n / n.sum(), size=per) @ d / n.sum())
            out.append(pd.DataFrame({"m": np.mean(means, axis=0)}))
        return pd.concat(out) if out else pd.DataFrame({"m": []})

    replicates = jobs.crossJoin(table).groupBy("id").applyInPandas(draw, "m double")  # one row of counts per block
    estimate = pairs.where("delta is not null").groupBy("domain").agg(F.avg("delta").alias("d")).agg(F.avg("d").alias("estimate"))
    interval = replicates.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return estimate.crossJoin(interval)


def lengths(rows: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return rows.agg(F.min(n).alias("shortest"), F.avg(n).alias("mean"), F.max(n).alias("longest"))


def distinct_report(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows and exact distinct counts of each key."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(k).alias(f"distinct_{k}") for k in keys])
