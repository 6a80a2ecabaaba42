"""Problem 6: records that differ in formatting only, collapsed and counted.

Records are canonicalised once and written; the canonical table is range
partitioned and sorted, and each partition is scanned run by run, comparing
full canonical keys. The range key ends in the record id, so a set of copies
that holds a third of all rows spreads over as many partitions as its size
asks for; the runs cut by a partition boundary, two per partition at most, are
put together again from one summary row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.pytext import alnum_key
from siftwright.session import Scratch, read_table


def canonical(question: pd.Series, options: pd.Series) -> pd.Series:
    """Canonical key: letters and digits of the question, then of the options in order of their text.

    A question without letters or digits gives null.
    """
    out = []
    for q, o in zip(question, options):
        head = alnum_key(q)
        parts = sorted(map(alnum_key, () if o is None else o))
        out.append("\x1e".join((head, str(len(parts)), "\x1f".join(parts))) if head else None)
    return pd.Series(out, dtype="object")


def canonical_records(rows: DataFrame) -> DataFrame:
    """``(h, key, id)``, one row per distinct id and canonical key."""
    key = F.pandas_udf(canonical, "string")
    keyed = rows.where("id is not null and question is not null").select("id", key("question", "options").alias("key"))
    return keyed.where("key is not null").select(F.xxhash64("key").alias("h"), "key", "id")


#: What a scan emits: members of runs (``id`` set) and one summary per run (``id`` null).
RUNS = "part int, run bigint, id string, keeper_id string, copies bigint, h bigint, key string"
_RUNS = pa.schema([
    ("part", pa.int32()), ("run", pa.int64()), ("id", pa.string()), ("keeper_id", pa.string()),
    ("copies", pa.int64()), ("h", pa.int64()), ("key", pa.string()),
])
_FLUSH = 20_000


def scan_runs(batches: Iterator[pa.RecordBatch], part: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in one partition sorted by ``h, key, id``.

    Of a run of two distinct ids or more every member comes out with the run's
    first id, and a summary with the exact count. Runs of the partition's first
    and last hash come out even if single, their summaries with the full key:
    they may go on in a neighbouring partition. Memory is one batch and the
    summaries of one hash, however long a run is.
    """
    if part is None:
        part = TaskContext.get().partitionId()
    out: list[tuple] = []
    pending: list[tuple] = []  # summaries of the hash being read
    first_h = h = key = keeper = last = None
    run, n = -1, 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(_RUNS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUNS)], schema=_RUNS)

    def close_run() -> None:
        if n:
            pending.append((part, run, None, keeper, n, h, key))

    def close_hash(edge: bool) -> None:
        for s in pending:
            if edge:
                if s[4] == 1:
                    out.append((part, s[1], s[3], s[3], None, None, None))
                out.append(s)
            elif s[4] > 1:
                out.append((*s[:5], None, None))
        pending.clear()

    for batch in batches:
        for nh, nkey, nid in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if nh == h and nkey == key:
                if nid == last:
                    continue
                if n == 1:
                    out.append((part, run, keeper, keeper, None, None, None))
                out.append((part, run, nid, keeper, None, None, None))
                n, last = n + 1, nid
                continue
            close_run()
            if nh != h:
                if h is not None:
                    close_hash(edge=h == first_h)
                first_h = nh if first_h is None else first_h
            h, key, keeper, last, n, run = nh, nkey, nid, nid, 1, run + 1
            if len(out) >= _FLUSH:
                yield batch_of(out)
                out.clear()
    close_run()
    close_hash(edge=True)
    yield batch_of(out)


def collapse(rows: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``members (id, keeper_id)`` and ``representatives (keeper_id, copies)``.

    Only records with at least one copy come out; ``keeper_id`` is the smallest
    id of the set and ``copies`` the number of distinct ids in it. Records with
    a null id, or whose question has no letter or digit, are no case; null
    options count as none, a null option as an empty one.
    """
    scratch = Scratch(spark, "copies")
    records = scratch.cut(canonical_records(rows))
    ordered = records.repartitionByRange("h", "id").sortWithinPartitions("h", "key", "id").select("h", "key", "id")
    scanned = scratch.cut(ordered.mapInArrow(scan_runs, RUNS))
    scratch.drop(records)
    runs = scanned.where("id is null")
    edges = runs.where("key is not null")  # two hashes per partition at most
    joined = edges.groupBy("h", "key").agg(F.min("keeper_id").alias("true_keeper"), F.sum("copies").alias("all_copies"))
    moved = edges.join(joined, ["h", "key"]).select("part", "run", "true_keeper", "all_copies")
    members = scanned.where("id is not null").join(F.broadcast(moved), ["part", "run"], "left")
    members = members.where("all_copies is null or all_copies > 1").select(
        "id", F.coalesce("true_keeper", "keeper_id").alias("keeper_id")
    )
    whole = runs.where("key is null").select("keeper_id", "copies").unionByName(
        joined.where("all_copies > 1").select(F.col("true_keeper").alias("keeper_id"), F.col("all_copies").alias("copies"))
    )
    return members.distinct(), whole


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(read_table(spark, sf_dir, "zagreus_exam_bank_v1").select("id", "question", "options"), spark)[0]


def p6_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative per set of copies with its exact number of copies."""
    return collapse(read_table(spark, sf_dir, "zagreus_exam_bank_v1").select("id", "question", "options"), spark)[1]
