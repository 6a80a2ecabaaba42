"""Hash-ordered ranking, quotas and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.keys import hash_bucket, order_key


#: Hex digits of a hash that name a bucket: 16**3 buckets for each stratum.
BUCKET_DIGITS = 3


def first_by(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order; the order must be total.

    A minimum over structs, so a key with a large share of all rows is
    pre-aggregated before the shuffle instead of sorted in one task.
    """
    rest = [c for c in rows.columns if c not in key]
    by = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)]
    best = rows.groupBy(*key).agg(F.min(F.struct(*by, *[F.col(c) for c in rest])).alias("_b"))
    return best.select(*key, *[F.col("_b")[c].alias(c) for c in rest]).select(*rows.columns)


def _running_out(rows: DataFrame, quotas: DataFrame, by: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their hash bucket, and per stratum the bucket in which its quota runs out and what is left for it."""
    bucketed = rows.withColumn("_bucket", F.substring(order, 1, BUCKET_DIGITS))
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by or [F.lit(0)]).orderBy("_bucket")
    cum = counts.withColumn("_upto", F.sum("_n").over(upto))
    joined = cum.join(quotas, by, "inner") if by else cum.crossJoin(quotas.limit(1))  # one row
    cut = joined.where(F.col("_upto") - F.col("_n") < F.col("quota")).groupBy(*by).agg(
        F.max(F.struct("_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("left"))).alias("_cut")
    )
    return bucketed, F.broadcast(cut)  # a row per stratum


def take_lowest(rows: DataFrame, quotas: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """The ``quota`` rows of lowest ``order`` hash (hex text) in each stratum ``by``; ties by ``key``.

    ``quotas (by, quota)`` has one row per stratum; it holds strata, not records.

    No stratum is sorted as a whole: hash buckets are counted, the bucket in
    which the quota runs out is found for each stratum, whole buckets below it
    are taken as they are, and only that one bucket is ranked.
    """
    bucketed, cut = _running_out(rows, quotas, by, order)
    with_cut = bucketed.join(cut, by, "inner") if by else bucketed.crossJoin(cut)
    below = with_cut.where(F.col("_bucket") < F.col("_cut._bucket"))
    w = Window.partitionBy(*by, "_bucket").orderBy(order, key)
    at = with_cut.where(F.col("_bucket") == F.col("_cut._bucket")).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("_cut.left"))
    return below.drop("_bucket", "_cut").unionByName(at.drop("_bucket", "_cut", "_rank"))


def mark_lowest(rows: DataFrame, quotas: DataFrame, by: list[str], key: str, order: str, name: str = "taken") -> DataFrame:
    """All rows with a boolean ``name``: whether ``take_lowest`` takes the row. A stratum without a quota takes none."""
    bucketed, cut = _running_out(rows, quotas, by, order)
    with_cut = bucketed.join(cut, by, "left")
    side = F.coalesce(F.col("_bucket") < F.col("_cut._bucket"), F.lit(False))
    ranked = F.coalesce(F.col("_bucket") == F.col("_cut._bucket"), F.lit(False))
    w = Window.partitionBy(*by, "_bucket").orderBy(order, key)
    at = with_cut.where(ranked).withColumn(name, F.row_number().over(w) <= F.col("_cut.left"))
    rest = with_cut.where(~ranked).withColumn(name, side)
    return rest.drop("_bucket", "_cut").unionByName(at.drop("_bucket", "_cut"))


def rank_in_hash_order(rows: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """Adds ``rank`` (0-based) and ``group_rows``: the place of each row of a stratum in hash order.

    Ranks are bucket offsets plus a rank within the bucket, so the largest
    stratum is spread over as many tasks as it has buckets.
    """
    bucketed = rows.withColumn("_bucket", F.substring(order, 1, BUCKET_DIGITS))
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by or [F.lit(0)])
    offsets = counts.select(
        *by, "_bucket", (F.sum("_n").over(w.orderBy("_bucket")) - F.col("_n")).alias("_offset"), F.sum("_n").over(w).alias("group_rows")
    )
    within = bucketed.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(order, key)))
    return within.join(offsets, [*by, "_bucket"]).select(*rows.columns, (F.col("_offset") + F.col("_rank") - 1).alias("rank"), "group_rows")


def short_strata(rows: DataFrame, quotas: DataFrame, by: str) -> DataFrame:
    """``(by, quota, available)`` of the strata that cannot fill their quota."""
    there = rows.groupBy(by).agg(F.count(F.lit(1)).alias("available"))
    joined = quotas.select(by, "quota").join(there, by, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return joined.where(F.col("available") < F.col("quota")).select(by, "quota", "available")


def quota_by(rows: DataFrame, quotas: DataFrame, by: str, key: str, order: Column, strict: bool = False) -> DataFrame:
    """The first ``quota`` rows of each stratum in hash order; strata without a quota give none.

    A stratum with fewer rows gives all it has, or, if ``strict``, is an error
    that names the first strata in question.
    """
    if strict and (short := short_strata(rows, quotas, by).orderBy(by).limit(5).collect()):
        raise ValueError("quotas that cannot be met: " + ", ".join(f"{r[by]}: {r['available']} of {r['quota']}" for r in short))
    return take_lowest(rows.withColumn("_h", order), quotas.select(by, "quota"), [by], key, "_h").select(rows.columns)


def place_in_order(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ``place``, the 1-based place within ``by`` when sorted by ``order``, over a range-partitioned sort."""
    from siftwright.session import Scratch

    ordered = rows.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id())
    ordered = Scratch(rows.sparkSession, "place").cut(ordered)  # the ranges are drawn once
    counts = ordered.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(by, "_part", (F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order))
    return ordered.withColumn("_w", within).join(before, [by, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_w")).alias("place"))


def first_n(rows: DataFrame, by: str, n: int, order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def top_k(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows with a 1-based ``rank``: bounded heaps per task, then one merge of k rows."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def apportion(weights: Mapping[str, int], total: int, seed: str) -> dict[str, int]:
    """Largest remainders, ties by seeded hash of the name."""
    import hashlib
    from fractions import Fraction

    whole = sum(weights.values())
    exact = {k: Fraction(total * w, whole) for k, w in weights.items()}
    got = {k: int(x) for k, x in exact.items()}
    tie = lambda k: hashlib.sha256(f"{seed}:remainder:{k}".encode()).hexdigest()
    for k in sorted(exact, key=lambda k: (got[k] - exact[k], tie(k)))[: total - sum(got.values())]:
        got[k] += 1
    return got


def apportion_table(weights: DataFrame, totals: DataFrame, seed: str) -> DataFrame:
    """``(total, domain, quota)`` for every total: the same rule on a small table of strata."""
    whole = Window.partitionBy("total")
    rows = totals.crossJoin(F.broadcast(weights))  # strata times candidate totals: bounded by both parameters
    rows = rows.withColumn("exact", F.col("total") * F.col("weight") % F.sum("weight").over(whole)).withColumn(
        "base", F.floor(F.col("total") * F.col("weight") / F.sum("weight").over(whole)).cast("bigint")
    )
    rest = F.col("total") - F.sum("base").over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc("exact"), order_key(seed, "remainder", F.col("domain"))))
    return rows.select("total", "domain", (F.col("base") + F.when(rank <= rest, 1).otherwise(0)).alias("quota"))


def largest_feasible(weights: DataFrame, available: DataFrame, totals: DataFrame, seed: str) -> DataFrame:
    """The largest total all of whose quotas the strata can supply (null if none can)."""
    need = apportion_table(weights, totals, seed).join(available, "domain", "left")
    ok = need.groupBy("total").agg(F.bool_and(F.coalesce("available", F.lit(0)) >= F.col("quota")).alias("fits"))
    return ok.where("fits").agg(F.max("total").alias("total"))


def whole_group_subset(sizes: Sequence[tuple[str, int]], target: int) -> list[str] | None:
    """Groups, in the given order, whose sizes sum to ``target``; null if no subset does.

    Subset sums over at most ``target`` totals: each total keeps the first way
    in which it was reached.
    """
    came: dict[int, tuple[int, str]] = {0: (-1, "")}
    for name, n in sizes:
        if 0 < n <= target:
            for at in sorted((t for t in came if t + n <= target), reverse=True):
                came.setdefault(at + n, (at, name))
        if target in came:
            break
    if target not in came:
        return None
    out, at = [], target
    while at:
        at, name = came[at]
        out.append(name)
    return out[::-1]


def allocate_whole_groups(groups: DataFrame, quotas: Mapping[str, int], rest: str, seed: str) -> DataFrame:
    """``(domain, group_id, split)``: exact quotas of whole groups per domain, the others to ``rest``.

    ``groups (domain, group_id, n)`` has one row per group. A domain in which
    some quota cannot be met exactly is left out. A subset of sum T holds at
    most T / n groups of size n, whichever they are, so of each size only that
    many groups, the first in hash order, go into the search: a bounded number
    per domain, however many groups it has.
    """
    import hashlib

    total, most = sum(quotas.values()), max(quotas.values())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        domain = pdf["domain"].iloc[0]
        free = dict(zip(pdf["group_id"], pdf["n"]))
        chosen: dict[str, str] = {}
        for split, target in quotas.items():
            key = lambda g: (hashlib.sha256(f"{seed}:{domain}:{split}:{g}".encode()).hexdigest(), g)  # noqa: B023, E731
            got = whole_group_subset([(g, int(free[g])) for g in sorted(free, key=key)], target)
            if got is None:
                return pd.DataFrame({"domain": [], "group_id": [], "split": []}, dtype="object")
            chosen.update(dict.fromkeys(got, split))
            for g in got:
                free.pop(g)
        return pd.DataFrame({"domain": domain, "group_id": [*chosen], "split": [*chosen.values()]})

    fit = groups.where((F.col("n") > 0) & (F.col("n") <= most)).withColumn("_h", order_key(seed, F.col("domain"), F.col("group_id")))
    sizes = fit.select("domain", "n").distinct().withColumn("quota", F.floor(F.lit(total) / F.col("n")).cast("bigint"))
    candidates = take_lowest(fit, sizes, ["domain", "n"], "group_id", "_h").select("domain", "group_id", "n")
    chosen = candidates.groupBy("domain").applyInPandas(one, "domain string, group_id string, split string")
    done = F.broadcast(chosen.select("domain").distinct())
    others = groups.join(done, "domain").select("domain", "group_id").join(chosen.select("domain", "group_id"), ["domain", "group_id"], "left_anti")
    return chosen.unionByName(others.withColumn("split", F.lit(rest)))


def sequential_quota(rows: DataFrame, domains: Sequence[tuple[str, int]], signature: str, order: list[Column | str]) -> DataFrame:
    """Domain after domain, the first rows in order whose signature no earlier row or domain has taken.

    ``domains`` is a parameter list; each step excludes what the steps before
    it took by an anti join, and repeats within the step by a window.
    """
    taken = None
    for domain, quota in domains:
        own = first_by(rows.where(F.col("domain") == domain), [signature], *order)
        if taken is not None:
            own = own.join(taken.select(signature), signature, "left_anti").select(own.columns)
        got = own.orderBy(*order).limit(quota)
        taken = got if taken is None else taken.unionByName(got)
    return taken


def preferred_mix(rows: DataFrame, preferred: Column, quota: int, share: float, order: list[Column | str]) -> DataFrame:
    """``quota`` rows, ``share`` of them (rounded half to even) from the preferred stratum where it has them, the rest in order from all others.

    Of each stratum only its first ``quota`` rows can matter; the two bounded
    lists are merged.
    """
    marked = rows.withColumn("_p", F.coalesce(preferred, F.lit(False)))
    best = marked.where("_p").orderBy(*order).limit(quota).unionByName(marked.where(~F.col("_p")).orderBy(*order).limit(quota))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    tier = F.when(F.col("_p") & (F.col("_k") <= round(quota * share)), 0).otherwise(1)
    return best.withColumn("_k", rank).withColumn("_tier", tier).orderBy("_tier", *order).limit(quota).drop("_p", "_k", "_tier")


def round_robin(slots: DataFrame, quota: int, group: str, slot: str, *order: Column | str) -> DataFrame:
    """Round after round one slot of each group in group order, until ``quota`` rows."""
    return slots.orderBy(slot, *order, group).limit(quota)


def hash_split(key: Column, bounds: Sequence[tuple[str, int]], n: int, seed: str, digits: int = 8) -> Column:
    """Split by hash bucket: each name takes that many of the ``n`` buckets, in order."""
    bucket, out, upto = hash_bucket(order_key(seed, key), n, digits), None, 0
    for name, k in bounds:
        upto += k
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return out


def cyclic_slot(rows: DataFrame, by: str, key: str, order: Column, name: str = "slot") -> DataFrame:
    """The k-th row of each count, in hash order, takes slot k mod count."""
    ranked = rank_in_hash_order(rows.withColumn("_h", order), [by], key, "_h")
    return ranked.select(*rows.columns, (F.col("rank") % F.col(by)).cast("int").alias(name))


def rank_slices(rank: Column, slices: Sequence[tuple[int, int]]) -> Column:
    """Value of the slice that a 1-based rank falls into: ``(value, rows)`` in order."""
    out, upto = None, 0
    for value, n in slices:
        upto += n
        out = F.when(rank <= upto, value) if out is None else out.when(rank <= upto, value)
    return out.otherwise(slices[-1][0])


def epoch_mix(signal: DataFrame, anchors: DataFrame, seed: str, share: float = 0.2) -> DataFrame:
    """Signal rows once and anchor rows repeated in hash order to ``share`` of the whole, in hash order.

    Both have ``id``. The result has ``kind, id, turn, place_key``; sorting by
    ``place_key`` gives the order of the epoch.
    """
    n_signal, n_anchor = signal.count(), anchors.count()
    want = -(-n_signal * round(share * 100) // (100 - round(share * 100)))
    out = signal.select(F.lit("signal").alias("kind"), "id", F.lit(0).alias("turn"))
    if n_anchor and want:
        hashed = anchors.select("id", order_key(seed, "anchor", F.col("id")).alias("_h"))
        ranked = rank_in_hash_order(hashed, [], "id", "_h").select("id", (F.col("rank") + 1).alias("k"))
        turns = F.floor((F.lit(want) - F.col("k")) / n_anchor).cast("int")
        repeated = ranked.where(F.col("k") <= want).select("id", F.explode(F.sequence(F.lit(0), turns)).alias("turn"))
        out = out.unionByName(repeated.select(F.lit("anchor").alias("kind"), "id", F.col("turn").cast("int").alias("turn")))
    return out.withColumn("place_key", order_key(seed, "place", F.col("kind"), F.col("id"), F.col("turn")))


def length_buckets(rows: DataFrame, position: str, length: str, pool: int, batch: int) -> DataFrame:
    """``pool_no`` and ``batch_no``: pools of consecutive positions, sorted by length inside, cut into batches."""
    w = Window.partitionBy("pool_no").orderBy(length, position)
    pooled = rows.withColumn("pool_no", F.floor(F.col(position) / pool).cast("bigint"))
    return pooled.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / batch).cast("int"))


def budget_bins(lengths: Sequence[int], budget: int) -> list[int]:
    """Bin number of each length: greedy prefixes whose longest entry times size stays in the budget.

    A prefix is the longest one that fits; an entry above the budget stands alone.
    """
    out: list[int] = []
    at, k = 0, 0
    while at < len(lengths):
        most, size = 0, 1
        for j in range(at, len(lengths)):
            most = max(most, lengths[j])
            if j > at and most * (j - at + 1) <= budget:
                size = j - at + 1
        out += [k] * size
        at, k = at + size, k + 1
    return out


def token_budget_bins(rows: DataFrame, by: list[str], order: str, length: str, budget: int) -> DataFrame:
    """Adds ``bin`` within each batch ``by`` (a batch is of bounded size)."""
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", bin int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(bin=budget_bins(pdf[length].astype(int).tolist(), budget))

    return rows.groupBy(*by).applyInPandas(one, schema)


def stale_counts(history: DataFrame, step: str, loss: str, least: float) -> DataFrame:
    """Evaluations in a row without an improvement of ``least`` on the best that counted, per run.

    ``history (run, step, loss)`` has one row per evaluation; the running state
    is a fold over the run's evaluations in step order.
    """
    ordered = history.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(step, loss))).alias("e"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.array().cast("array<struct<step:bigint,stale:int>>").alias("out"))

    def fold(s: Column, e: Column) -> Column:
        better = s["best"] - e[loss] >= least
        stale = F.when(better, 0).otherwise(s["stale"] + 1)
        return F.struct(
            F.when(better, e[loss]).otherwise(s["best"]).alias("best"), stale.alias("stale"),
            F.concat(s["out"], F.array(F.struct(e[step].cast("bigint").alias("step"), stale.alias("stale")))).alias("out"),
        )

    return ordered.select("run", F.explode(F.aggregate("e", start, fold)["out"]).alias("x")).select("run", "x.step", "x.stale")
