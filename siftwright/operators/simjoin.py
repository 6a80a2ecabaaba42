"""Similarity joins.

Against a protected reference of bounded size (``best_matches``) the inverted
index of the reference is sent to all tasks and each row is scored in one scan:
no shuffle, no candidate rows. Its size is checked; a larger reference is cut
into blocks. Within a corpus (``jaccard_pairs``) rows with equal sets collapse
first; the rest meet through prefix filtering: tokens are ordered from rare to
common, and two sets that reach the threshold share one of their first few.
Both are exact.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.session import Scratch

#: Postings of a reference block that a task holds (8 bytes each).
BLOCK_POSTINGS = 8_000_000
_WORKER: dict[str, tuple] = {}


def reference_blocks(reference: DataFrame, limit: int = BLOCK_POSTINGS) -> Iterator[list]:
    """The reference ``(ref_id, tokens)`` in lists of bounded size."""
    postings, rows = reference.agg(F.sum(F.greatest(F.size("tokens"), F.lit(0))), F.count(F.lit(1))).first()
    n = max(1, -(-(postings or 0) // limit))
    for k in range(n if rows else 0):
        part = reference if n == 1 else reference.where(F.pmod(F.xxhash64("ref_id"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.select("ref_id", "tokens").collect()]


def _scorer(sent, measure: str, threshold: float, min_size: int, best: bool, key_type: pa.DataType, ref_type: pa.DataType):
    token = uuid.uuid4().hex
    schema = pa.schema([("id", key_type), ("ref_id", ref_type), ("overlap", pa.int32()), ("score", pa.float64())])

    def index() -> tuple:
        found = _WORKER.get(token)
        if found is None:
            rows = sorted(sent.value, key=lambda r: r[0])
            postings: dict[str, list[int]] = defaultdict(list)
            for k, (_, tokens) in enumerate(rows):
                if len(tokens) >= min_size:
                    for t in tokens:
                        postings[t].append(k)
            _WORKER.clear()
            found = ([r[0] for r in rows], np.array([len(r[1]) for r in rows], dtype=np.int64), {t: np.array(p, dtype=np.int64) for t, p in postings.items()})
            _WORKER[token] = found
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, postings = index()
        for batch in batches:
            ids, refs, overlaps, scores = [], [], [], []
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tokens is None or len(tokens) < max(1, min_size):
                    continue
                lists = [p for t in tokens if (p := postings.get(t)) is not None]
                if not lists:
                    continue
                hits = np.bincount(np.concatenate(lists), minlength=len(names))
                base = np.minimum(sizes, len(tokens)) if measure == "containment" else sizes + len(tokens) - hits
                value = hits / np.maximum(base, 1)
                keep = np.flatnonzero((value >= threshold) & (hits > 0))
                if best and len(keep):
                    keep = keep[[int(np.argmax(value[keep]))]]  # rows are in order of ref_id: ties go to the lowest
                ids += [key] * len(keep)
                refs += [names[k] for k in keep]
                overlaps += hits[keep].tolist()
                scores += value[keep].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, refs, overlaps, scores), schema)], schema=schema)

    return run


def reference_matches(
    rows: DataFrame, reference: DataFrame, measure: str, threshold: float, min_size: int = 0, best: bool = False
) -> DataFrame:
    """``(id, ref_id, overlap, score)`` of rows against a reference, exactly.

    ``rows (id, tokens)`` and ``reference (ref_id, tokens)`` hold distinct
    tokens. ``measure`` is ``jaccard`` or ``containment`` (of the smaller set,
    both with ``min_size`` tokens at least). With ``best`` each row keeps its
    highest score only; ties go to the lowest ``ref_id``. Null and empty token
    arrays match nothing.
    """
    spark = rows.sparkSession
    kinds = {f.name: f.dataType for f in rows.select("id").schema.fields + reference.select("ref_id").schema.fields}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    key, ref = (arrow[kinds[c].simpleString()] for c in ("id", "ref_id"))
    schema = f"id {kinds['id'].simpleString()}, ref_id {kinds['ref_id'].simpleString()}, overlap int, score double"
    out = None
    for block in reference_blocks(reference):
        part = rows.select("id", "tokens").mapInArrow(_scorer(spark.sparkContext.broadcast(block), measure, threshold, min_size, best, key, ref), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    if best:
        top = out.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "ref_id", "overlap")).alias("b"))
        out = top.select("id", "b.ref_id", "b.overlap", (-F.col("b.s")).alias("score"))
    return out


def set_classes(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``members (id, rep, by)`` and one row per distinct token set ``(id, tokens, by)``; ``rep`` is the lowest id."""
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    keyed = rows.where(F.size("tokens") > 0).select("id", *by, F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    keyed = keyed.withColumn("_set", F.sha2(F.array_join("tokens", "\x1f"), 256))
    reps = keyed.groupBy(*by, "_set").agg(F.min("id").alias("rep"))
    members = keyed.join(reps, [*by, "_set"]).select("id", "rep", *by, "tokens")
    return members.select("id", "rep", *by), members.where(F.col("id") == F.col("rep")).select("id", *by, "tokens")


def jaccard_pairs(rows: DataFrame, threshold: float, by: list[str], spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Exact Jaccard self join within ``by``: ``pairs (a, b, score, by)`` of class representatives, and ``members``.

    ``rows (id, tokens, by)``. Rows with the same token set are one class; a
    pair is listed once, ``a < b``. Rows without tokens or with a null class
    are left out.
    """
    scratch = Scratch(spark, "jaccard")
    members, reps = set_classes(scratch.cut(rows.select("id", *by, "tokens")), by)  # tokenised once
    reps = scratch.cut(reps)
    tokens = reps.select("id", *by, F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    df = tokens.groupBy(*by, "t").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("id", *by).orderBy("df", "t")
    ranked = tokens.join(df, [*by, "t"]).where("df > 1").withColumn("k", F.row_number().over(w))
    # tokens that one set only has cannot match: they take up prefix places of their own set
    shared = Window.partitionBy("id", *by)
    ranked = ranked.withColumn("lone", F.col("n") - F.count(F.lit(1)).over(shared))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    prefix = ranked.where(F.col("k") <= prefix - F.col("lone")).select("id", *by, "n", "t")
    left, right = (prefix.select(F.col("id").alias(c), *by, F.col("n").alias("n" + c), "t") for c in ("a", "b"))
    met = left.join(right, [*by, "t"]).where("a < b")
    met = met.where((F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(threshold) * F.col("na") - 1e-9))
    met = met.select("a", "b", *by).distinct()
    sets = reps.select("id", *by, "tokens")
    full = met.join(sets.withColumnRenamed("id", "a").withColumnRenamed("tokens", "ta"), ["a", *by])
    full = full.join(sets.withColumnRenamed("id", "b").withColumnRenamed("tokens", "tb"), ["b", *by])
    both = F.size(F.array_intersect("ta", "tb"))
    scored = full.withColumn("score", both / (F.size("ta") + F.size("tb") - both)).where(F.col("score") >= threshold)
    return scored.select("a", "b", "score", *by), members


def cosine_hits(rows: DataFrame, queries: DataFrame, threshold: float | None, by: str | None = None, block: int = 4096) -> DataFrame:
    """``(query_id, id, score)``: all rows against a query set, by matrix products over Arrow batches.

    ``rows`` and ``queries`` have ``id, vector`` and may have a class column
    ``by`` that must agree. The query set is cut into blocks of at most
    ``block`` vectors, each its own scan. With ``threshold`` None the best row
    of each query comes out (ties: lowest id); a vector never matches its own id.
    Null, empty and zero vectors match nothing.
    """
    spark = rows.sparkSession
    count = queries.count()
    n = max(1, -(-count // block))
    label = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    base = rows.where("id is not null and size(vector) > 0").select("id", "vector", label.alias("label"))
    asked = queries.where("id is not null and size(vector) > 0").select("id", "vector", label.alias("label"))
    schema = "query_id bigint, id bigint, score double"
    arrow = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    out = None
    for k in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
        sent = spark.sparkContext.broadcast([(r.id, list(r.vector), r.label) for r in part.collect()])  # at most a block of vectors

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            width = len(known[0][1]) if known else 0
            q = unit(np.array([v for _, v, _ in known if len(v) == width], dtype=np.float64)) if known else None
            qid = np.array([i for i, v, _ in known if len(v) == width], dtype=np.int64)
            qlabel = np.array([x for _, v, x in known if len(v) == width])
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = batch.column(1).to_pylist()
                fit = np.array([len(v) == width and None not in v for v in vectors], dtype=bool)
                if q is None or not fit.any():
                    continue
                x = unit(np.array([v for v, ok in zip(vectors, fit) if ok], dtype=np.float64))
                own, labels = ids[fit], np.array(batch.column(2).to_pylist())[fit]
                s = np.nan_to_num(x @ q.T, nan=-np.inf)
                s[(own[:, None] == qid[None, :]) | (labels[:, None] != qlabel[None, :])] = -np.inf
                if threshold is None:
                    best = s.max(axis=0)
                    pick = [(int(np.min(own[s[:, j] == best[j]])), j) for j in np.flatnonzero(np.isfinite(best))]
                    rows_, cols = [p[0] for p in pick], [p[1] for p in pick]
                    data = (qid[cols].tolist(), rows_, [float(best[j]) for j in cols])
                else:
                    i, j = np.nonzero(s >= threshold)
                    data = (qid[j].tolist(), own[i].tolist(), s[i, j].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, arrow)], schema=arrow)

        found = base.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    if threshold is None:
        top = out.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
        out = top.select("query_id", "b.id", (-F.col("b.s")).alias("score"))
    return out


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def containment_pairs(rows: DataFrame, threshold: float, min_size: int, by: list[str], spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Exact containment self join within ``by``: ``pairs (a, b, score, by)`` of class representatives, and ``members``.

    The score is the overlap over the smaller set; sets of fewer than
    ``min_size`` tokens are left out. A set that is contained to the
    threshold shares one of its few rarest tokens with the other, so only those
    are looked up in the whole of the other sets. A pair is listed once, ``a < b``.
    """
    scratch = Scratch(spark, "containment")
    large_enough = rows.select("id", *by, "tokens").where(F.size(F.array_distinct("tokens")) >= min_size)
    members, reps = set_classes(scratch.cut(large_enough), by)
    reps = scratch.cut(reps)
    tokens = reps.select("id", *by, F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    df = tokens.groupBy(*by, "t").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(df, [*by, "t"]).withColumn("k", F.row_number().over(Window.partitionBy("id", *by).orderBy("df", "t")))
    few = ranked.where((F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1) & (F.col("df") > 1))
    small = few.select(F.col("id").alias("x"), *by, F.col("n").alias("nx"), "t")
    large = tokens.select(F.col("id").alias("y"), *by, F.col("n").alias("ny"), "t")
    met = small.join(large, [*by, "t"]).where("x <> y and nx <= ny").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *by).distinct()
    sets = reps.select("id", *by, "tokens")
    full = met.join(sets.withColumnRenamed("id", "a").withColumnRenamed("tokens", "ta"), ["a", *by])
    full = full.join(sets.withColumnRenamed("id", "b").withColumnRenamed("tokens", "tb"), ["b", *by])
    score = F.size(F.array_intersect("ta", "tb")) / F.least(F.size("ta"), F.size("tb"))
    return full.withColumn("score", score).where(F.col("score") >= threshold).select("a", "b", "score", *by), members
