"""Content keys, seeded orders and integers from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwright.functions.text import norm_fold, norm_keep

RECORD_SEPARATOR, UNIT_SEPARATOR = "\x1e", "\x1f"


def question_hash(question: Column) -> Column:
    return F.sha2(norm_fold(question), 256)


def record_key(question: Column, options: Column) -> Column:
    """Hash of the normalised question and its sorted normalised options."""
    opts = F.array_join(F.array_sort(F.transform(options, norm_fold)), UNIT_SEPARATOR)
    return F.sha2(F.concat(norm_fold(question), F.lit(RECORD_SEPARATOR), opts), 256)


def signature(context: Column, question: Column, options: Column) -> Column:
    """Context, question and sorted options in the accent-keeping normal form."""
    return F.struct(norm_keep(context).alias("context"), norm_keep(question).alias("question"), F.array_sort(F.transform(options, norm_keep)).alias("options"))


def canonical_json_hash(**fields: Column) -> Column:
    """Hash of a compact JSON object with sorted keys; null fields are written as null."""
    inner = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(inner, 256)


def order_key(*parts: Column | str) -> Column:
    """A seeded order: hash of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def hash_int(hex_hash: Column, digits: int = 8) -> Column:
    """Integer of the first hex digits: 8 fit a bigint, 16 need a decimal."""
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("bigint" if digits < 16 else "decimal(20,0)")


def hash_bucket(hex_hash: Column, n: int, digits: int = 8) -> Column:
    return (hash_int(hex_hash, digits) % F.lit(n)).cast("int")


def family_id(ids: Column) -> Column:
    """Content hash of a list of member ids, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)
