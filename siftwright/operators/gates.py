"""Checks, manifests and audit packets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.operators.ranking import top_k


def gate(checks: DataFrame) -> DataFrame:
    """One row ``(passed, failed)`` from ``checks (name, ok)``; a null check fails, no checks pass nothing."""
    ok = F.coalesce("ok", F.lit(False))
    return checks.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("passed"), F.count_if(~ok).alias("failed"))


def check_table(spark: SparkSession, rows: DataFrame, **predicates: Column) -> DataFrame:
    """``(name, ok)``: each aggregate predicate over ``rows`` in one pass."""
    one = rows.agg(*[p.alias(k) for k, p in predicates.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("ok")) for k in predicates])
    return one.select(F.explode(pairs).alias("c")).select("c.name", "c.ok")


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, or of its part files' hashes in path order."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashes = [r[0] for r in parts.select(F.sha2("content", 256), "path").orderBy("path").collect()]  # one hash per file
    return hashes[0] if len(hashes) == 1 else hashlib.sha256("\n".join(hashes).encode()).hexdigest()


def pin(spark: SparkSession, path: str, expected: str) -> None:
    found = file_hash(spark, path)
    if found != expected:
        raise ValueError(f"{path}: hash {found}, expected {expected}")


def content_pin(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row ``(rows, keys, content_hash)``: a hash of the rows that does not depend on their order or files.

    Row hashes fall into buckets by their first digits, each bucket's sorted
    list is hashed, and the bucket hashes in order give the table's.
    """
    from siftwright.functions.keys import family_id

    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *columns)])
    hashed = rows.select(F.col(key).alias("k"), F.sha2(text, 256).alias("h"))
    parts = hashed.groupBy(F.substring("h", 1, 3).alias("b")).agg(family_id(F.collect_list("h")).alias("part"), F.count(F.lit(1)).alias("n"))
    whole = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), family_id(F.collect_list(F.concat("b", "part"))).alias("content_hash"))  # 4096 buckets at most
    return whole.crossJoin(hashed.agg(F.countDistinct("k").alias("keys"))).select("rows", "keys", "content_hash")  # one row by one row


def require_content(pinned: DataFrame, rows: int, content_hash: str) -> None:
    """Raises unless the row of ``content_pin`` has the expected count and hash."""
    found = pinned.first()
    if found["rows"] != rows or found["content_hash"] != content_hash:
        raise ValueError(f"{found['rows']} rows, hash {found['content_hash']}; expected {rows}, {content_hash}")


def allowed_sources(rows: DataFrame, source: str, prefixes: Sequence[str], licence: str, licences: Sequence[str]) -> DataFrame:
    """Adds ``source_ok`` and ``licence_ok``: a source that begins with an allowed prefix, a licence that is listed. Null is neither."""
    begins = [F.coalesce(F.col(source).startswith(p), F.lit(False)) for p in prefixes]
    any_of = F.lit(False)
    for b in begins:
        any_of = any_of | b
    return rows.withColumn("source_ok", any_of).withColumn("licence_ok", F.coalesce(F.col(licence).isin(*licences), F.lit(False)))


def keys_in_json(value: object, forbidden: set[str], at: str = "") -> list[str]:
    """Paths of the keys of a parsed JSON value, at any depth, that are forbidden."""
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            out += ([path] if k in forbidden else []) + keys_in_json(v, forbidden, path)
    elif isinstance(value, list):
        for v in value:
            out += keys_in_json(v, forbidden, at + "[]")
    return out


def private_keys(column: Column, forbidden: Sequence[str]) -> Column:
    """Distinct paths of forbidden keys in JSON texts; null for null, a path ``?`` where the text is no JSON."""
    names = frozenset(forbidden)

    def visit(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            try:
                found.append(None if t is None else sorted(set(keys_in_json(json.loads(t), names))))
            except ValueError:
                found.append(["?"])
        return pd.Series(found)

    return F.pandas_udf(visit, "array<string>")(column)


def manifest(status: str, counts: DataFrame, thresholds: Mapping[str, float], lineage: Mapping[str, str]) -> str:
    """JSON with sorted keys: status, counts ``(name, n)``, thresholds, hashes of the inputs."""
    found = {r[0]: r[1] for r in counts.select("name", "n").collect()}  # a row per counter
    return json.dumps({"status": status, "counts": found, "thresholds": dict(thresholds), "lineage": dict(lineage)}, sort_keys=True, ensure_ascii=False)


def require_status(text: str, expected: str) -> dict:
    """The manifest of the stage before, if it has the status this stage needs."""
    found = json.loads(text)
    if found.get("status") != expected:
        raise ValueError(f"status {found.get('status')!r}, needed {expected!r}")
    return found


def private_fields(schema, forbidden: set[str], at: str = "") -> list[str]:
    """Paths of fields, at any depth, whose name is forbidden."""
    out = []
    if hasattr(schema, "fields"):
        for f in schema.fields:
            path = f"{at}.{f.name}" if at else f.name
            if f.name in forbidden:
                out.append(path)
            out += private_fields(f.dataType, forbidden, path)
    for inner in ("elementType", "valueType"):
        if hasattr(schema, inner):
            out += private_fields(getattr(schema, inner), forbidden, at + "[]")
    return out


def audit_packet(scored: DataFrame, k: int, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``k`` closest pairs with earlier verdicts carried over, and a text-free public index.

    ``scored (candidate_id, matched_id, score, text)``, ``decided (candidate_id,
    matched_id, verdict)``. Order: score downwards, then both ids.
    """
    packet = top_k(scored, k, F.desc("score"), "candidate_id", "matched_id")
    packet = packet.join(decided, ["candidate_id", "matched_id"], "left")
    return packet, packet.select("rank", "candidate_id", "matched_id", "score", F.coalesce("verdict", F.lit("pending")).alias("verdict"))
