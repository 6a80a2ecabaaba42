"""Views that the queries share, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.arrays import renormalise
from siftwright.operators.filters import four_distinct_options
from siftwright.session import read_table

INSTRUMENT, BANK = "zagreus_final_instrument", "zagreus_exam_bank_v1"
ITEM_COLUMNS = ["id", "source", "source_split", "group_id", "context", "question", "options", "gold", "domain"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, each delivery of an id once."""
    return read_table(spark, sf_dir, INSTRUMENT).select(*ITEM_COLUMNS).distinct()


def valid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = four_distinct_options(F.col("options"), F.col("gold")) & (F.trim("question") != "") & F.col("domain").isNotNull() & F.col("group_id").isNotNull()
    return items(spark, sf_dir).where(ok)


def hash_share(*parts: Column) -> Column:
    """An integer 1 to 65536 from a hash: the stand-in for scores that a model would give."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 4), 16, 10).cast("int") + 1


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, domain, group_id, gold, view, p``: four views of every valid item with a posterior each."""
    rows = valid_items(spark, sf_dir).select("id", "domain", "group_id", "gold", F.explode(F.array(*[F.lit(v) for v in range(4)])).alias("view"))
    raw = F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: hash_share(F.col("id"), F.col("view"), k) * F.when(k == F.col("gold"), 2.0).otherwise(1.0))
    return rows.withColumn("p", renormalise(raw))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    return views(spark, sf_dir).withColumn("prediction", top).withColumn("correct", F.col("prediction") == F.col("gold"))


def sql_fold(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower(coalesce({x}, '')), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def sql_keep(x: str) -> str:
    return f"lower(trim(regexp_replace(translate(coalesce({x}, ''), '‘’“”', '''''\"\"'), '[\\s\\x{{a0}}]+', ' ', 'g')))"


def sql_int(x: str, digits: int = 8) -> str:
    return f"('0x' || substr({x}, 1, {digits}))::BIGINT"


ITEMS_SQL = f"items as (select distinct {', '.join(ITEM_COLUMNS)} from {INSTRUMENT})"
_K = sql_keep("o")
VALID_SQL = f"""{ITEMS_SQL},
valid as (
  select * from items where len(options) = 4 and gold between 0 and 3 and trim(question, ' ') <> '' and domain is not null and group_id is not null
    and len(list_distinct([{_K} for o in options])) = 4 and not list_contains([{_K} for o in options], ''))"""
VIEWS_SQL = f"""{VALID_SQL},
raw as (
  select id, domain, group_id, gold, v::int as view,
    [({sql_int("sha256(id || ':' || v || ':' || k)", 4)} + 1) * (case when k = gold then 2.0::double else 1.0::double end) for k in [0, 1, 2, 3]] r
  from valid, range(4) t(v)),
views as (select id, domain, group_id, gold, view, [x / (r[1] + r[2] + r[3] + r[4]) for x in r] p from raw),
preds as (
  select *, (list_position(p, list_max(p)) - 1)::int as prediction, (list_position(p, list_max(p)) - 1) = gold as correct from views)"""
