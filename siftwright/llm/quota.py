"""Problem 4: a sample in target proportions, by top-down allocation over a tree.

Wanted rows per category are set at the leaves from share and minimum and add
up along a category tree of any depth. The allocation goes down the tree: a
node hands to each child what it wants, as far as the child's leaves can supply
it, and what is missing goes to the other children in proportion to what they
have to spare. So what a leaf lacks is made up by its siblings first, by its
cousins if the siblings cannot, and what nobody can supply is reported as
unmet. Rows are then drawn at the leaves by a permuted dense rank: every row
has its position in hash order within the leaf, and each request takes the
positions that its own permutation sends below the quota.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.llm.common import BUCKET_DIGITS, fold, hash_hex
from siftwright.session import Scratch, read_table

#: Parent of each category or family, to any depth; what is not listed hangs from the root. A parameter of every call.
FAMILIES = {
    "lexicon": "language", "morphology": "language", "orthography": "language",
    "synonyms_and_antonyms": "language", "syntax": "language",
    "art_history": "culture", "history": "culture", "literature": "culture",
    "civic_education": "society", "geography": "society", "tourism": "society",
}

ALLOCATION = (
    "request_id int, domain string, family string, wanted bigint, available bigint, own bigint, "
    "from_siblings bigint, from_cousins bigint, quota bigint, short bigint, unmet bigint"
)


def category(c: str) -> Column:
    """Folded, with spaces and hyphens read as underscores."""
    return F.regexp_replace(fold(c), r"[\s\-]", "_")


def share_out(amount: int, spare: dict[str, int]) -> dict[str, int]:
    """Largest-remainder division of ``amount`` in proportion to ``spare``, never above it."""
    total = sum(spare.values())
    amount = min(amount, total)
    if amount <= 0:
        return {}
    exact = {k: amount * v / total for k, v in spare.items()}
    got = {k: min(spare[k], math.floor(x)) for k, x in exact.items()}
    rest = amount - sum(got.values())
    for k in sorted(exact, key=lambda k: (got[k] - exact[k], k)):
        if rest and got[k] < spare[k]:
            got[k] += 1
            rest -= 1
    return got


def path_to(name: str, tree: Mapping[str, str]) -> list[str]:
    """Ancestors of a category from the root downwards."""
    path: list[str] = []
    while name in tree:
        name = tree[name]
        if name in path:
            raise ValueError(f"the category tree runs in a circle at {name!r}")
        path.append(name)
    return path[::-1]


def allocate(rows: pd.DataFrame, tree: Mapping[str, str] = FAMILIES) -> pd.DataFrame:
    """Quotas of one request; ``rows`` has ``request_id, domain, wanted, available``.

    ``short`` is what the leaf itself lacks, ``unmet`` the part of it that no
    other leaf could make up.
    """
    rows = rows.sort_values("domain").reset_index(drop=True)
    names = list(rows["domain"])
    wanted, there = dict(zip(names, rows["wanted"].astype(int))), dict(zip(names, rows["available"].astype(int)))
    children: dict[tuple, set[tuple]] = {(): set()}
    want: Counter = Counter()
    supply: Counter = Counter()
    for name in names:
        at = [("node", x) for x in path_to(name, tree)] + [("leaf", name)]
        if name in tree.values():  # a family that is asked for by its own name has the rows so named
            at.insert(-1, ("node", name))
        for k in range(len(at) + 1):
            want[tuple(at[:k])] += wanted[name]
            supply[tuple(at[:k])] += there[name]
            if k:
                children.setdefault(tuple(at[: k - 1]), set()).add(tuple(at[:k]))
    own, siblings, cousins = {}, dict.fromkeys(names, 0), dict.fromkeys(names, 0)

    def push(node: tuple, quota: int, more: int) -> None:
        """Hands ``quota`` rows wanted below ``node``, and ``more`` that are wanted elsewhere, to its children."""
        below = sorted(children[node])
        first = {c: min(want[c], supply[c]) for c in below}
        spare = {c: supply[c] - first[c] for c in below}
        near = share_out(quota - sum(first.values()), spare)
        far = share_out(more, {c: spare[c] - near.get(c, 0) for c in below})
        for c in below:
            if c[-1][0] == "leaf":
                own[c[-1][1]], siblings[c[-1][1]], cousins[c[-1][1]] = first[c], near.get(c, 0), far.get(c, 0)
            else:
                push(c, first[c], near.get(c, 0) + far.get(c, 0))

    push((), min(want[()], supply[()]), 0)
    short = {k: wanted[k] - own[k] for k in names}
    unmet = share_out(max(0, want[()] - supply[()]), short)
    out = rows[["request_id", "domain", "wanted", "available"]].copy()
    out["family"] = [(path_to(k, tree) or [k])[-1] for k in names]
    for column, values in (("own", own), ("from_siblings", siblings), ("from_cousins", cousins)):
        out[column] = [values[k] for k in names]
    out["quota"] = out["own"] + out["from_siblings"] + out["from_cousins"]
    out["short"] = [short[k] for k in names]
    out["unmet"] = [unmet.get(k, 0) for k in names]
    return out[[c.split()[0] for c in ALLOCATION.split(", ")]]


def members(rows: DataFrame) -> DataFrame:
    """Distinct ``(id, domain)``; rows without id or domain belong to no category.

    An id delivered again counts once; one delivered under two domains is a
    member of both.
    """
    return rows.where("id is not null and domain is not null").select("id", category("domain").alias("domain")).distinct()


def allocation(people: DataFrame, targets: DataFrame, tree: Mapping[str, str] = FAMILIES) -> DataFrame:
    """The report: what each request wants of each domain, gets from where, and lacks.

    One task sees one request, whose rows are the categories of the targets.
    """
    supply = people.groupBy("domain").agg(F.count(F.lit(1)).alias("available"))
    wanted = targets.where("request_id is not null and domain is not null").select(
        F.col("request_id").cast("int").alias("request_id"), category("domain").alias("domain"),
        F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(F.col("target_share") * F.col("sample_size")).cast("bigint"), F.lit(0)).alias("wanted"),
    )
    wanted = wanted.groupBy("request_id", "domain").agg(F.max("wanted").alias("wanted"))
    rows = wanted.join(supply, "domain", "left").select(
        "request_id", "domain", "wanted", F.coalesce("available", F.lit(0)).alias("available")
    )
    tree = dict(tree)
    return rows.groupBy("request_id").applyInPandas(lambda pdf: allocate(pdf, tree), ALLOCATION)


def draw(people: DataFrame, quotas: DataFrame, seed: str = "quota-1") -> DataFrame:
    """``(request_id, domain, id, place)`` of the rows whose permuted rank is below the quota.

    The permutation of request q is ``rank -> (a * rank + b) mod n`` with
    ``a`` 1 or -1 and ``b`` from q: one to one for every n, so quotas are met
    exactly, and requests start at different places of the hash order. The
    ranks a request takes are one stretch of that order, round its end, so only
    rows in hash buckets that some stretch touches are ranked.
    """
    scratch = Scratch(people.sparkSession, "draw")
    rows = scratch.cut(people.select("id", "domain", hash_hex(seed, F.col("id")).alias("h")).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)))
    wanted = quotas.where("quota > 0").select("request_id", "domain", "quota")
    counts = rows.groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("m"))  # categories times buckets
    w = Window.partitionBy("domain")
    offsets = counts.select(
        "domain", "bucket", "m", (F.sum("m").over(w.orderBy("bucket")) - F.col("m")).alias("offset"), F.sum("m").over(w).alias("n")
    )
    q, n = F.col("request_id").cast("bigint"), F.col("n")
    shift = F.pmod(q * F.lit(2654435761), n)
    begin = F.when(q % 2 == 0, F.pmod(n - F.pmod(-shift, n) - F.col("quota"), n)).otherwise(F.pmod(-shift, n))
    stretch = offsets.join(wanted, "domain").withColumn("begin", begin)
    touched = (F.pmod(F.col("offset") - F.col("begin"), n) < F.col("quota")) | (F.pmod(F.col("begin") - F.col("offset"), n) < F.col("m"))
    stretch = scratch.cut(stretch.where(touched).select("request_id", "domain", "bucket", "offset", "n", "quota"))
    # written tables: their size decides whether they are broadcast
    needed = rows.join(stretch.select("domain", "bucket").distinct(), ["domain", "bucket"], "left_semi")
    within = F.row_number().over(Window.partitionBy("domain", "bucket").orderBy("h", "id"))
    ranked = needed.withColumn("within", within).join(stretch, ["domain", "bucket"]).withColumn("rank", F.col("offset") + F.col("within") - 1)
    turned = F.when(q % 2 == 0, n - 1 - F.col("rank")).otherwise(F.col("rank"))
    placed = ranked.withColumn("place", F.pmod(turned + shift, n))
    return placed.where("place < quota").select("request_id", "domain", "id", "place")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = members(read_table(spark, sf_dir, "zagreus_scaled_kd_data"))
    return allocation(people, read_table(spark, sf_dir, "kd_sample_targets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target rows whose own domain cannot supply them, from the allocation report."""
    report = p4_report(spark, sf_dir).where("short > 0").select("request_id", F.col("domain").alias("key"))
    targets = read_table(spark, sf_dir, "kd_sample_targets").select("request_id", "domain", category("domain").alias("key"))
    return report.join(targets, ["request_id", "key"]).select("request_id", "domain").distinct()


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quota")
    people = scratch.cut(members(read_table(spark, sf_dir, "zagreus_scaled_kd_data")))
    return draw(people, scratch.cut(allocation(people, read_table(spark, sf_dir, "kd_sample_targets"))))


def p4_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sample holds of each domain: rows, distinct ids and distinct places, beside what the leaf can give."""
    drawn = p4_sample(spark, sf_dir).groupBy("request_id", "domain").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.countDistinct("place").alias("places")
    )
    return drawn.groupBy("request_id").agg(F.sum("rows").alias("rows"), F.sum("ids").alias("ids"), F.sum("places").alias("places"))


P4_SQL = """
with people as (
  select distinct id, lower(regexp_replace(regexp_replace(domain, '^\\s+|\\s+$', '', 'g'), '[\\s\\-]', '_', 'g')) as domain
  from zagreus_scaled_kd_data where id is not null and domain is not null),
supply as (select domain, count(*) n from people group by domain)
select distinct request_id, t.domain
from kd_sample_targets t left join supply s
  on s.domain = lower(regexp_replace(regexp_replace(t.domain, '^\\s+|\\s+$', '', 'g'), '[\\s\\-]', '_', 'g'))
where coalesce(s.n, 0) < greatest(t.min_rows, round(t.target_share * t.sample_size))
"""

#: A request draws what its domains want together, or all rows of its domains where these are fewer.
P4_DRAWN_SQL = """
with people as (
  select distinct id, lower(regexp_replace(regexp_replace(domain, '^\\s+|\\s+$', '', 'g'), '[\\s\\-]', '_', 'g')) as domain
  from zagreus_scaled_kd_data where id is not null and domain is not null),
supply as (select domain, count(*) n from people group by domain),
wanted as (
  select request_id, lower(regexp_replace(regexp_replace(domain, '^\\s+|\\s+$', '', 'g'), '[\\s\\-]', '_', 'g')) as domain,
    max(greatest(coalesce(min_rows, 0), round(target_share * sample_size)::bigint, 0)) w from kd_sample_targets group by 1, 2),
total as (select request_id, least(sum(w), sum(coalesce(n, 0)))::bigint as rows from wanted left join supply using (domain) group by request_id)
select request_id, rows, rows as ids, rows as places from total where rows > 0
"""
