"""Queries of ranking, quotas, splits and batch layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwright.functions import keys as K
from siftwright.operators import joins
from siftwright.operators import ranking as R
from siftwright.plans.base import ITEMS_SQL, VALID_SQL, items, sql_fold, sql_int, valid_items
from siftwright.plans.registry import query
from siftwright.session import read_table

SEED = "rank-1"
_H = "sha256('rank-1:' || id)"


def _order():
    return [K.order_key(SEED, F.col("id")), F.col("id")]


@query("first_by_hash_order", f"with {ITEMS_SQL}, r as (select id, row_number() over (partition by {sql_fold('question')} order by {_H}, id) k from items) select id from r where k = 1")
def first_by_hash_order(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", K.question_hash(F.col("question")).alias("h"))
    return R.first_by(rows, ["h"], *_order()).select("id")


WEIGHTS = (("history", 3), ("geography", 2), ("lexicon", 2), ("syntax", 1), ("tourism", 1))
TOTAL = 40
_W = "(values " + ", ".join(f"('{d}', {w})" for d, w in WEIGHTS) + ") t(domain, weight)"


def _weights(spark):
    return spark.createDataFrame(list(WEIGHTS), "domain string, weight bigint")


def _quota_sql(totals: str) -> str:
    return f"""w as (select domain, weight::bigint weight from {_W}), tt as ({totals}), x as (select total, domain, weight, sum(weight) over (partition by total) s from w, tt),
    y as (select total, domain, (total * weight) % s e, (total * weight) // s b, s from x), z as (select *, total - sum(b) over (partition by total) rest,
      row_number() over (partition by total order by e desc, sha256('{SEED}:remainder:' || domain)) k from y), quotas as (select total, domain, (b + case when k <= rest then 1 else 0 end)::bigint quota from z)"""


@query("apportioned_quotas", f"with {_quota_sql('select unnest([7, 40, 101, 1000])::bigint total')} select total, domain, quota from quotas")
def apportioned_quotas(spark, sf_dir):
    totals = spark.createDataFrame([(7,), (40,), (101,), (1000,)], "total bigint")
    return R.apportion_table(_weights(spark), totals, SEED)


@query("quota_sample", f"with {VALID_SQL}, {_quota_sql(f'select {TOTAL}::bigint total')}, r as (select v.id, domain, quota, row_number() over (partition by domain order by {_H.replace('id', 'v.id')}, v.id) k from valid v join quotas using (domain)) select id, domain from r where k <= quota")
def quota_sample(spark, sf_dir):
    quotas = R.apportion_table(_weights(spark), spark.createDataFrame([(TOTAL,)], "total bigint"), SEED).select("domain", "quota")
    return R.quota_by(valid_items(spark, sf_dir).select("id", "domain"), quotas, "domain", "id", _order()[0]).select("id", "domain")


@query("largest_feasible_total", f"with {VALID_SQL}, {_quota_sql('select range::bigint total from range(100, 100001, 100)')}, a as (select domain, count(*) n from valid group by domain), f as (select total, bool_and(coalesce(n, 0) >= quota) ok from quotas left join a using (domain) group by total) select max(total) as total from f where ok")
def largest_feasible_total(spark, sf_dir):
    available = valid_items(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("available"))
    totals = spark.range(100, 100_001, 100).select(F.col("id").alias("total"))
    return R.largest_feasible(_weights(spark), available, totals, SEED)


@query("fixed_sample_by_domain", f"with {VALID_SQL}, r as (select id, domain, row_number() over (partition by domain order by {_H}, id) k from valid) select id, domain from r where k <= 10")
def fixed_sample_by_domain(spark, sf_dir):
    return R.first_n(valid_items(spark, sf_dir).select("id", "domain"), "domain", 10, _order())


@query("global_top_k", f"with {ITEMS_SQL}, r as (select id, row_number() over (order by {_H}, id)::int as rank from items) select id, rank from r where rank <= 50")
def global_top_k(spark, sf_dir):
    return R.top_k(items(spark, sf_dir).select("id"), 50, *_order())


@query("smallest_groups_by_split", f"with {ITEMS_SQL}, g as (select source_split, group_id, count(*) n from items where group_id is not null and source_split is not null group by 1, 2), r as (select *, row_number() over (partition by source_split order by n, sha256('rank-1:' || group_id), group_id) k from g) select source_split, group_id, n from r where k <= 5")
def smallest_groups_by_split(spark, sf_dir):
    groups = items(spark, sf_dir).where("group_id is not null and source_split is not null").groupBy("source_split", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return R.first_n(groups, "source_split", 5, ["n", K.order_key(SEED, F.col("group_id")), "group_id"])


@query("whole_group_allocation")
def whole_group_allocation(spark, sf_dir):
    """Exact quotas of whole groups per domain."""
    groups = valid_items(spark, sf_dir).groupBy("domain", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return R.allocate_whole_groups(groups, {"diagnosis": 8, "early": 8, "holdout": 12}, "train", SEED)


DOMAINS = (("history", 15), ("geography", 15), ("lexicon", 15))


@query("sequential_quota")
def sequential_quota(spark, sf_dir):
    """Domain after domain, no question twice."""
    rows = valid_items(spark, sf_dir).select("id", "domain", K.question_hash(F.col("question")).alias("signature"))
    return R.sequential_quota(rows, DOMAINS, "signature", _order()).select("id", "domain")


@query("preferred_mix", f"with {VALID_SQL}, m as (select id, starts_with(source, 'synthetic_') p from valid), f as (select id, coalesce(p, false) p, row_number() over (partition by coalesce(p, false) order by {_H}, id) k from m), r as (select id, row_number() over (order by case when p and k <= 60 then 0 else 1 end, {_H}, id) n from f) select id from r where n <= 100")
def preferred_mix(spark, sf_dir):
    rows = valid_items(spark, sf_dir).select("id", "source")
    return R.preferred_mix(rows, F.col("source").startswith("synthetic_"), 100, 0.6, _order()).select("id")


@query("round_robin", f"with {VALID_SQL}, s as (select id, domain, row_number() over (partition by domain order by {_H}, id) k from valid), r as (select id, row_number() over (order by k, sha256('rank-1:' || domain), domain) n from s) select id from r where n <= 75")
def round_robin(spark, sf_dir):
    slots = valid_items(spark, sf_dir).select("id", "domain").withColumn("slot", F.row_number().over(Window.partitionBy("domain").orderBy(*_order())))
    slots = slots.where("slot <= 75")  # a later slot cannot come up within 75 rows
    return R.round_robin(slots, 75, "domain", "slot", K.order_key(SEED, F.col("domain"))).select("id")




@query("hash_splits", f"with {ITEMS_SQL} select id, case when {sql_int("sha256('split:' || coalesce(group_id, id))")} % 5 = 0 then 'dev' else 'train' end as two_way, case {sql_int("sha256('split:' || coalesce(group_id, id))")} % 10 when 0 then 'dev' when 1 then 'test' else 'train' end as three_way from items")
def hash_splits(spark, sf_dir):
    key = F.coalesce("group_id", "id")
    return items(spark, sf_dir).select("id", R.hash_split(key, [("dev", 1), ("train", 4)], 5, "split").alias("two_way"), R.hash_split(key, [("dev", 1), ("test", 1), ("train", 8)], 10, "split").alias("three_way"))


@query(
    "split_leak_report",
    f"""with {ITEMS_SQL}, s as (select distinct group_id, source_split from items where group_id is not null and source_split is not null),
    n as (select group_id, count(*) n from s group by group_id)
    select source_split as split, count(*) as groups, count(*) filter (where n > 1) as leaking from s join n using (group_id) group by source_split""",
)
def split_leak_report(spark, sf_dir):
    """Groups of each split as delivered, and how many of them stand in another split too."""
    rows = items(spark, sf_dir).where("group_id is not null and source_split is not null").select("group_id", F.col("source_split").alias("split"))
    return joins.leaking_keys(rows, "group_id")


@query("option_count_by_rank", f"with {VALID_SQL}, r as (select id, domain, row_number() over (partition by domain order by {_H}, id) k from valid) select id, case when k <= 20 then 3 when k <= 80 then 4 else 5 end as options from r")
def option_count_by_rank(spark, sf_dir):
    rows = R.rank_in_hash_order(valid_items(spark, sf_dir).select("id", "domain", _order()[0].alias("h")), ["domain"], "id", "h")
    return rows.select("id", R.rank_slices(F.col("rank") + 1, [(3, 20), (4, 60), (5, 0)]).alias("options"))


_SLOTS_SQL = f"{VALID_SQL}, c as (select id, ({sql_int("sha256('count:' || id)")} % 3 + 3)::int n from valid), s as (select id, n, ((row_number() over (partition by n order by {_H}, id) - 1) % n)::int slot from c)"


def _slots(spark, sf_dir):
    rows = valid_items(spark, sf_dir).select("id", (K.hash_bucket(K.order_key("count", F.col("id")), 3) + 3).alias("n"))
    return R.cyclic_slot(rows, "n", "id", _order()[0])


@query("balanced_slots", f"with {_SLOTS_SQL} select id, n, slot from s")
def balanced_slots(spark, sf_dir):
    return _slots(spark, sf_dir).select("id", "n", "slot")


@query("slot_balance", f"with {_SLOTS_SQL}, h as (select n, slot, count(*) c from s group by n, slot) select n, (max(c) - min(c))::bigint as spread from h group by n")
def slot_balance(spark, sf_dir):
    counts = _slots(spark, sf_dir).groupBy("n", "slot").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("n").agg((F.max("c") - F.min("c")).alias("spread"))


@query("gold_slot_balance", f"with {VALID_SQL} select id, ((row_number() over (partition by domain order by {_H}, id) - 1) % 4)::int as slot from valid")
def gold_slot_balance(spark, sf_dir):
    rows = R.rank_in_hash_order(valid_items(spark, sf_dir).select("id", "domain", _order()[0].alias("h")), ["domain"], "id", "h")
    return rows.select("id", (F.col("rank") % 4).cast("int").alias("slot"))


@query("epoch_mix", f"with {VALID_SQL}, s as (select id from valid where domain <> 'history'), a as (select id, row_number() over (order by sha256('mix:anchor:' || id), id) k, count(*) over () n from valid where domain = 'history'), w as (select ceil((select count(*) from s) * 20 / 80)::bigint want), x as (select id, unnest(range(0, ((want - k) // n + 1)::bigint)) turn from a, w where k <= want) select 'signal' as kind, id, 0::int as turn from s union all select 'anchor', id, turn::int from x")
def epoch_mix(spark, sf_dir):
    rows = valid_items(spark, sf_dir).select("id", "domain")
    return R.epoch_mix(rows.where("domain <> 'history'").select("id"), rows.where("domain = 'history'").select("id"), "mix").select("kind", "id", "turn")


@query("length_buckets", "with b as (select doc_id, doc_id // 512 pool_no, length(text) n from documents where text is not null) select doc_id, pool_no, ((row_number() over (partition by pool_no order by n, doc_id) - 1) // 32)::int as batch_no from b")
def length_buckets(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    return R.length_buckets(rows, "doc_id", "n", 512, 32).select("doc_id", "pool_no", "batch_no")


@query("token_budget_bins")
def token_budget_bins(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    batches = R.length_buckets(rows, "doc_id", "n", 512, 32)
    return R.token_budget_bins(batches, ["pool_no", "batch_no"], "doc_id", "n", 16_384).select("doc_id", "pool_no", "batch_no", "bin")


@query("best_run", "with r as (select user_id, round(avg(value), 6) score, count(*) n from events where value is not null group by user_id) select user_id, score from r order by score desc, n desc, user_id limit 1")
def best_run(spark, sf_dir):
    """The best run by score, then rows, then lowest id."""
    rows = read_table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("score"), F.desc("n"), "user_id").limit(1).select("user_id", "score")


@query("stale_evaluations")
def stale_evaluations(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").where("value is not null").select((F.col("user_id") % 16).alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    sampled = rows.groupBy("run", F.floor(F.col("step") / 500).alias("step")).agg(F.round(F.avg("loss"), 6).alias("loss"))  # one evaluation per 500 events
    return R.stale_counts(sampled, "step", "loss", 0.01)


@query("total_order", f"with {ITEMS_SQL} select id, row_number() over (partition by domain order by id)::int as place from items where domain is not null")
def total_order(spark, sf_dir):
    """Place of each id within its domain in code point order."""
    rows = items(spark, sf_dir).where("domain is not null").select("id", "domain")
    return R.place_in_order(rows, "domain", "id").select("id", F.col("place").cast("int").alias("place"))


