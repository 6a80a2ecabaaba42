"""JSON lines, Parquet and text files.

All writers use Spark's commit protocol: a table appears whole or not at all.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines, plain or gzipped, under a declared schema; blank lines are skipped.

    ``strict`` fails on a malformed line, else such lines come out as nulls.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_filtered_jsonl(spark: SparkSession, path: str, schema: StructType | str, column: str, value: str) -> DataFrame:
    """JSON lines of one language (or other class); the filter reaches the JSON parser."""
    return read_jsonl(spark, path, schema, strict=False).where(F.col(column) == value)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists", order: Sequence[str] = ()) -> None:
    """Compact JSON lines with nulls kept and non-ASCII letters as they are.

    With ``order`` the rows are range-partitioned and sorted, so reading the part
    files in name order gives the total order.
    """
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_pending(rows: DataFrame, done_path: str, schema: StructType | str, key: str = "id") -> int:
    """Appends the rows whose key is not in the table yet; returns their number. Safe to repeat."""
    spark = rows.sparkSession
    try:
        done = read_jsonl(spark, done_path, schema).select(key).distinct()
        rows = rows.join(done, key, "left_anti").select(rows.columns)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    from siftwright.session import Scratch

    fresh = Scratch(spark, "append").cut(rows)
    n = fresh.count()
    if n:
        write_jsonl(fresh, done_path, "append")
    return n


def read_json_document(text: str) -> dict:
    return json.loads(text)


def write_json_document(value: Mapping) -> str:
    """Sorted keys, two spaces, final newline."""
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def discover(spark: SparkSession, root: str, include: str, exclude: Sequence[str] = ()) -> DataFrame:
    """``(path, length)`` of files under ``root`` whose path matches ``include`` and lies in no excluded folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    found = found.where(F.col("path").rlike(include))
    for folder in exclude:
        found = found.where(~F.col("path").contains(f"/{PurePosixPath(folder).name}/"))
    return found


def project(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Allowed columns only, in that order; a column that is missing is an error."""
    return rows.select(*allowed)


def write_matrix(rows: DataFrame, path: str, key: str, vector: str) -> None:
    """Score matrix as Parquet rows ``(key, vector)``."""
    rows.select(key, vector).write.mode("errorifexists").parquet(path)


def load_protected(spark: SparkSession, path: str, expected_rows: int | None = None, expected_hash: str | None = None) -> DataFrame:
    """The protected table with its row count and file hash checked."""
    from siftwright.operators.gates import pin

    if expected_hash:
        pin(spark, path, expected_hash)
    rows = spark.read.parquet(path)
    if expected_rows is not None and rows.count() != expected_rows:
        raise ValueError(f"{path}: {rows.count()} rows, expected {expected_rows}")
    return rows


def parse_benchmark_options(options_json: str = "options", answer: str = "answer") -> list:
    """Columns ``options`` and ``gold`` from a JSON list of one-key maps and an answer label."""
    maps = F.from_json(options_json, "array<map<string,string>>")
    labels = F.transform(maps, lambda m: F.element_at(F.map_keys(m), 1))
    values = F.transform(maps, lambda m: F.element_at(F.map_values(m), 1))
    return [values.alias("options"), (F.array_position(labels, F.col(answer)) - 1).cast("int").alias("gold")]
