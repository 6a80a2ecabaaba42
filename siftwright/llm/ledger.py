"""Problem 3: a sample that stays the same as data grows.

The sampled unit is the key ``(source_id, group_id)``, folded. A ledger stored
in a folder holds every key decided about so far, with the decision. A run
loads it, keeps all its keys by a join, decides about the keys it has never
seen and appends them; nothing in it is ever changed or dropped. So what was
chosen once stays chosen, whatever arrives later, in whatever order, and a key
once passed over is not reconsidered.

The ledger grows by whole versions: a run writes its decisions beside the
ledger and renames them into place, so a run that breaks off leaves the ledger
as it was, and the next one decides the same.
"""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import fold, hash_hex
from siftwright.operators.ranking import mark_lowest
from siftwright.session import Scratch, read_table, shared_dir

RATE = 0.05
SEED = "ledger-1"
LEDGER = "key string, chosen boolean, entered int"
SAMPLE = "id string, source_id string, group_id string, snapshot_no int, chosen_at int"


class Ledger:
    """Decisions ``(key, chosen, entered)`` in a folder that all executors and later runs reach.

    ``entered`` is the snapshot of which the decision was made. Versions are
    folders ``v00001``, ``v00002``, ...; anything else in there is ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def versions(self) -> list[str]:
        """Names of the committed versions, oldest first."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted(n for n in names if n[:1] == "v" and n[1:].isdigit())

    def load(self) -> DataFrame:
        paths = [f"{self.path}/{v}" for v in self.versions()]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def append(self, decided: DataFrame) -> None:
        """Commits ``decided`` as the next version, wholly or not at all."""
        ready = f"{self.path}/_{uuid.uuid4().hex}"
        decided.select("key", "chosen", "entered").write.option("compression", "zstd").parquet(ready)
        at = self._path(f"{self.path}/v{len(self.versions()) + 1:05d}")
        if self._fs.exists(at) or not self._fs.rename(self._path(ready), at):
            raise RuntimeError(f"another run wrote {at.getName()} of the ledger in {self.path}")


def sampling_key(source_id: str = "source_id", group_id: str = "group_id", row_id: str = "id") -> Column:
    """The folded pair; a missing half is empty, and a row with neither is its own key."""
    s, g = F.coalesce(fold(source_id), F.lit("")), F.coalesce(fold(group_id), F.lit(""))
    return F.when((s == "") & (g == ""), F.concat(F.lit("row\x1f"), F.col(row_id))).otherwise(F.concat_ws("\x1f", s, g))


def growth_quotas(new: dict[int, int], seen: int, chosen: int, rate: float) -> dict[int, int]:
    """How many of the ``new`` keys of each snapshot are chosen, snapshot after snapshot.

    After each snapshot ``ceil(rate * keys decided about)`` keys are to be
    chosen; the growth comes from its new keys, as far as they go.
    """
    out = {}
    for k in sorted(new):
        seen += new[k]
        out[k] = max(0, min(new[k], ceil(round(rate * seen, 6)) - chosen))
        chosen += out[k]
    return out


def decide(ledger: DataFrame, fresh: DataFrame, rate: float, seed: str) -> DataFrame:
    """``(key, chosen, entered)`` of the keys ``fresh (key, snapshot_no)`` that the ledger does not know.

    In each snapshot the keys of lowest hash are chosen, ties by key. What is
    collected is one row per snapshot.
    """
    new = {r[0]: r[1] for r in fresh.groupBy("snapshot_no").count().collect()}
    seen, chosen = ledger.agg(F.count(F.lit(1)), F.coalesce(F.count_if("chosen"), F.lit(0))).first()
    quotas = growth_quotas(new, seen, chosen, rate)
    table = fresh.sparkSession.createDataFrame(list(quotas.items()), "snapshot_no int, quota bigint")
    marked = mark_lowest(fresh.withColumn("h", hash_hex(seed, F.col("key"))), table, ["snapshot_no"], "key", "h", "chosen")
    return marked.select("key", "chosen", F.col("snapshot_no").alias("entered"))


def ledger_sample(rows: DataFrame, spark: SparkSession, ledger_path: str, rate: float = RATE, seed: str = SEED) -> DataFrame:
    """All rows of chosen keys: ``(id, source_id, group_id, snapshot_no, chosen_at)``.

    ``rows`` needs ``id, source_id, group_id, snapshot_no`` and may hold all
    deliveries or only the new ones; ``ledger_path`` is where decisions are kept
    between runs (a new folder starts a new sample). An id delivered repeatedly
    comes out once, as its first delivery under a chosen key; null ids and rows
    without a snapshot number are not part of any delivery and are left out.
    ``chosen_at`` is the snapshot in which the row came into the sample. No rows
    give no rows and leave the ledger as it is.
    """
    scratch = Scratch(spark, "ledger")
    ledger = Ledger(spark, ledger_path)
    keyed = rows.where("id is not null and snapshot_no is not null").select(
        "id", "source_id", "group_id", F.col("snapshot_no").cast("int").alias("snapshot_no"), sampling_key().alias("key")
    )
    keyed = scratch.cut(keyed)  # the source is read and folded once
    known = ledger.load()
    fresh = keyed.groupBy("key").agg(F.min("snapshot_no").alias("snapshot_no")).join(known.select("key"), "key", "left_anti")
    fresh = scratch.cut(fresh)
    if not fresh.isEmpty():
        ledger.append(decide(known, fresh, rate, seed))
    scratch.drop(fresh)
    chosen = ledger.load().where("chosen").select("key", "entered")
    kept = keyed.join(chosen, "key").groupBy("id").agg(F.min(F.struct("snapshot_no", "key", "source_id", "group_id", "entered")).alias("r"))
    return kept.select("id", "r.source_id", "r.group_id", "r.snapshot_no", F.greatest("r.snapshot_no", "r.entered").alias("chosen_at"))


def p3_ledger_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of all six snapshots, with a ledger that this run begins."""
    path = f"{shared_dir(spark).rstrip('/')}/sample-ledger-{uuid.uuid4().hex}"
    return ledger_sample(read_table(spark, sf_dir, "zagreus_scaled_kd_data"), spark, path)


#: The operator's rule for a ledger that begins empty: growth of the quota per first snapshot.
P3_SQL = """
with deliveries as (
  select id, source_id, group_id, snapshot_no, case when s = '' and g = '' then 'row' || chr(31) || id else s || chr(31) || g end as key from (
    select id, source_id, group_id, snapshot_no,
      coalesce(lower(regexp_replace(source_id, '^\\s+|\\s+$', '', 'g')), '') s,
      coalesce(lower(regexp_replace(group_id, '^\\s+|\\s+$', '', 'g')), '') g
    from zagreus_scaled_kd_data where id is not null and snapshot_no is not null)),
keys as (select key, min(snapshot_no) entered from deliveries group by key),
per as (select entered, count(*) n from keys group by entered),
quota as (
  select entered, ceil(0.05 * sum(n) over (order by entered)) - coalesce(ceil(0.05 * (sum(n) over (order by entered) - n)), 0) q
  from per),
ranked as (
  select key, entered, row_number() over (partition by entered order by md5('ledger-1' || chr(31) || key), key) k from keys),
kept as (
  select id, min(struct_pack(snapshot_no := snapshot_no, key := key, source_id := source_id, group_id := group_id, entered := entered)) r
  from deliveries join ranked using (key) join quota using (entered) where k <= q group by id)
select id, r.source_id source_id, r.group_id group_id, r.snapshot_no snapshot_no, greatest(r.snapshot_no, r.entered) chosen_at from kept
"""
