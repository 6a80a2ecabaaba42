"""Problem 7: texts into containers of fixed capacity, first fit decreasing.

Texts are measured in tokens of a public tokenizer, once. Documents are put
into groups at random, by hash, of about ``GROUP_ROWS`` documents each; within
a group they are placed, longest first, into the first container with enough
room, which a tournament tree over the containers' free room finds in
logarithmic time. Groups are independent, so the work spreads over the cluster
and no task sees more than a group. A text above the capacity is cut into full
containers and a rest that is placed like any other text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.session import Scratch, read_table

#: Byte-level BPE ranks, one "base64 rank" per line; a parameter of every call.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-level BPE splits a text before merging (the vocabulary's own pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_ROWS = 4096
SEED = 41


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("engine", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(vocabulary: str = VOCABULARY) -> Callable:
    """Arrow-batched UDF: tokens of a text; null for null."""

    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(vocabulary)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return F.pandas_udf(count, "bigint")


class Tournament:
    """Free room of containers in order of opening; finds the first with room enough."""

    def __init__(self, leaves: int, capacity: int):
        self.base = 1 << max(0, (max(leaves, 1) - 1).bit_length())
        self.most = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        most, i = self.most, 1
        while i < self.base:
            i *= 2
            if most[i] < size:
                i += 1
        most[i] -= size
        slot = i - self.base
        while i > 1:
            i //= 2
            left, right = most[2 * i], most[2 * i + 1]
            most[i] = left if left > right else right
        return slot


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """For each item the pieces ``(container, start, length)``; containers count from 0.

    Items above the capacity fill containers of their own and leave a rest;
    items of size 0 or less take no room and get no piece.
    """
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    used, rest = 0, []
    for i, n in enumerate(sizes):
        start = 0
        while n - start > capacity:
            pieces[i].append((used, start, capacity))
            used, start = used + 1, start + capacity
        if n > start:
            rest.append((n - start, i, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(rest), capacity)
    for n, i, start in rest:
        pieces[i].append((used + tree.place(n), start, n))
    return pieces


PACKED = "budget_id int, capacity bigint, group_no bigint, container bigint, doc_id bigint, piece int, start bigint, tokens bigint"


def pack_group(budgets: list[tuple[int, int]]) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id"], kind="stable")
        docs, sizes, group = pdf["doc_id"].tolist(), pdf["tokens"].astype("int64").tolist(), int(pdf["group_no"].iloc[0])
        rows = []
        for budget, capacity in budgets:
            for doc, parts in zip(docs, pack(sizes, capacity)):
                rows.extend((budget, capacity, group, c, doc, k, start, n) for k, (c, start, n) in enumerate(parts))
        columns = [c.split()[0] for c in PACKED.split(", ")]
        return pd.DataFrame(rows, columns=columns)

    return run


def pack_texts(
    texts: DataFrame, budgets: DataFrame, spark: SparkSession, vocabulary: str = VOCABULARY, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per piece: budget, group, container, ``doc_id``, piece number, start and tokens.

    ``texts (doc_id, text)``; ``budgets (budget_id, capacity_tokens)`` is a small
    table of container kinds. Null and empty texts have no tokens and are not
    placed; a repeated ``doc_id`` is an item for each of its rows. Budgets with
    a null or non-positive capacity are left out.
    """
    kinds = [(int(b), int(c)) for b, c in budgets.where("budget_id is not null and capacity_tokens > 0")
             .select("budget_id", "capacity_tokens").distinct().orderBy("budget_id", "capacity_tokens").collect()]
    scratch = Scratch(spark, "packing")
    measured = scratch.cut(texts.where("doc_id is not null and length(text) > 0").select("doc_id", token_counter(vocabulary)("text").alias("tokens")))
    groups = max(1, -(-measured.count() // group_rows))
    grouped = measured.withColumn("group_no", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(groups)))
    tasks = min(groups, 4 * spark.sparkContext.defaultParallelism)  # asked for by number, so that small groups are not put into one task
    return grouped.repartition(tasks, "group_no").groupBy("group_no").applyInPandas(pack_group(kinds), PACKED)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "token_budgets"), spark)


def p7_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share for each capacity."""
    containers = p7_packed(spark, sf_dir).groupBy("budget_id", "capacity", "group_no", "container").agg(F.sum("tokens").alias("tokens"))
    return containers.groupBy("budget_id", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"),
        (1 - F.sum("tokens") / (F.count(F.lit(1)) * F.col("capacity"))).alias("unused_share"),
    )
