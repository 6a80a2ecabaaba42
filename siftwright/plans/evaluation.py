"""Queries of evaluation metrics and counting reports, on posteriors derived from hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions import arrays as A
from siftwright.functions import keys as K
from siftwright.functions import text as X
from siftwright.operators import aggregates as G
from siftwright.operators import joins
from siftwright.plans.base import ITEMS_SQL, VALID_SQL, VIEWS_SQL, items, predictions, sql_fold, sql_int, valid_items, views
from siftwright.plans.registry import query
from siftwright.session import read_table


@query("macro_accuracy", f"with {VIEWS_SQL}, d as (select domain, avg(correct::int) a, sum(correct::int) c, count(*) n from preds group by domain) select round(avg(a), 9) as macro, round(sum(c) / sum(n), 9) as micro, sum(n)::bigint as rows from d")
def macro_accuracy(spark, sf_dir):
    m = G.macro_accuracy(predictions(spark, sf_dir))
    return m.select(F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "rows")


@query(
    "view_agreement",
    f"""with {VIEWS_SQL}, v as (select id, prediction, count(*) c from preds group by id, prediction), a as (select id, sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) g from v group by id)
    select round(avg(g), 9) as agreement, count(*) as rows from a""",
)
def view_agreement(spark, sf_dir):
    return G.view_agreement(predictions(spark, sf_dir)).select(F.round("agreement", 9).alias("agreement"), "rows")


_ENSEMBLE_SQL = f"""{VIEWS_SQL}, m as (select id, domain, gold, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4])] q from views group by id, domain, gold),
ens as (select *, (list_position([round(x, 12) for x in q], list_max([round(x, 12) for x in q])) - 1) = gold as correct from m)"""


def _ensemble(spark, sf_dir):
    rows = views(spark, sf_dir).groupBy("id", "domain", "gold").agg(*[F.avg(F.element_at("p", k + 1)).alias(f"m{k}") for k in range(4)])
    rows = rows.withColumn("q", F.array("m0", "m1", "m2", "m3"))
    return rows.withColumn("correct", A.top1(F.transform("q", lambda x: F.round(x, 12))) == F.col("gold"))


@query("ensemble_accuracy", f"with {_ENSEMBLE_SQL}, d as (select domain, avg(correct::int) a, sum(correct::int) c, count(*) n from ens group by domain) select round(avg(a), 9) as macro, round(sum(c) / sum(n), 9) as micro, sum(n)::bigint as rows from d")
def ensemble_accuracy(spark, sf_dir):
    m = G.macro_accuracy(_ensemble(spark, sf_dir))
    return m.select(F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "rows")


@query("negative_log_likelihood", f"with {VIEWS_SQL} select view, round(avg(-ln(greatest(p[gold + 1], 1e-12))), 8) as nll from views group by view")
def negative_log_likelihood(spark, sf_dir):
    loss = -F.log(F.greatest(F.element_at("p", F.col("gold") + 1), F.lit(A.TINY)))
    return views(spark, sf_dir).groupBy("view").agg(F.round(F.avg(loss), 8).alias("nll"))


@query(
    "stable_wrong_and_longest",
    f"""with {VIEWS_SQL}, s as (select id, count(distinct prediction) = 1 and not bool_or(correct) as stable_wrong from preds group by id),
    l as (select p.id, length(v.options[p.prediction + 1]) = list_max([length(o) for o in v.options]) as longest from preds p join valid v using (id))
    select (select round(avg(stable_wrong::int), 9) from s) as stable_wrong_rate, (select round(avg(longest::int), 9) from l) as longest_choice_rate""",
)
def stable_wrong_and_longest(spark, sf_dir):
    p = predictions(spark, sf_dir)
    wrong = p.groupBy("id").agg((F.countDistinct("prediction") == 1).alias("one"), F.bool_or("correct").alias("any"))
    wrong = wrong.agg(F.round(F.avg((F.col("one") & ~F.col("any")).cast("double")), 9).alias("stable_wrong_rate"))
    chosen = p.join(valid_items(spark, sf_dir).select("id", "options"), "id")
    longest = F.length(F.element_at("options", F.col("prediction") + 1)) == F.array_max(F.transform("options", lambda o: F.length(o)))
    return wrong.crossJoin(chosen.agg(F.round(F.avg(longest.cast("double")), 9).alias("longest_choice_rate")))  # one row each


@query("letter_shares", f"with {VIEWS_SQL}, c as (select prediction, count(*) n from preds group by prediction) select prediction, n, round(n / (select sum(n) from c), 9) as share, round(abs(n / (select sum(n) from c) - 0.25), 9) as off from c")
def letter_shares(spark, sf_dir):
    s = G.letter_shares(predictions(spark, sf_dir))
    return s.select("prediction", "n", F.round("share", 9).alias("share"), F.round("off", 9).alias("off"))


@query(
    "generation_rates",
    f"""with {VIEWS_SQL}, g as (select domain, case prediction when 0 then 'A' when 1 then 'B.' when 2 then ' C' else 'Z' end o, gold, view from preds),
    f as (select domain, nullif(regexp_extract(o, '([A-Z])', 1), '') l, trim(o) t, ['A', 'B', 'C', 'D'][gold + 1] g, view % 2 = 0 as ended from g)
    select domain, round(avg((l = g)::int), 9) as accuracy, round(avg(regexp_full_match(l, '[A-D]')::int), 9) as valid, round(avg(regexp_full_match(t, '[A-D]')::int), 9) as exact,
      round(avg((regexp_full_match(t, '[A-D]') and ended)::int), 9) as immediate_end from f group by domain""",
)
def generation_rates(spark, sf_dir):
    """Accuracy, valid and exact outputs, and outputs of one answer letter and the end mark at once, over all views."""
    out = F.when(F.col("prediction") == 0, "A").when(F.col("prediction") == 1, "B.").when(F.col("prediction") == 2, " C").otherwise("Z")
    letters, end = F.array(*[F.lit(x) for x in "ABCD"]), F.lit("<end>")
    # what the model gave, as tokens: the answer, and in every second view the end mark right behind it
    tokens = F.when(F.col("view") % 2 == 0, F.array(F.trim(out), end)).otherwise(F.array(F.trim(out), F.lit("..."), end))
    rows = predictions(spark, sf_dir).select("domain", F.element_at(letters, F.col("gold") + 1).alias("g"), out.alias("o"), tokens.alias("tokens"))
    rows = rows.select("domain", "g", X.immediate_end(F.col("tokens"), letters, end).alias("ended"), *[c.alias(k) for k, c in X.parse_answer(F.col("o")).items()])
    return G.generation_rates(rows.withColumn("correct", F.col("parsed") == F.col("g")))


@query(
    "paired_delta",
    f"""with {VIEWS_SQL}, w as (select a.domain, a.correct x, b.correct y from preds a join preds b using (id) where a.view = 0 and b.view = 1)
    select domain, count(*) as n, count(*) filter (where not x and y) as gains, count(*) filter (where x and not y) as losses, round(avg(y::int) - avg(x::int), 9) as delta from w group by domain""",
)
def paired_delta(spark, sf_dir):
    p = predictions(spark, sf_dir).select("id", "domain", "correct", "view")
    found = joins.paired(p.where("view = 0"), p.where("view = 1"))
    return found.withColumn("delta", F.round("delta", 9))


def _question_deltas(spark, sf_dir):
    p = predictions(spark, sf_dir)
    half = lambda lo: F.avg(F.when(F.col("view").isin(lo, lo + 1), F.col("correct").cast("double")))
    return p.groupBy("id", "domain").agg((half(2) - half(0)).alias("delta"))


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    """Paired macro delta of two pairs of views with its bootstrap interval."""
    return G.bootstrap_interval(_question_deltas(spark, sf_dir), samples=2000)


@query(
    "bootstrap_estimate",
    f"""with {VIEWS_SQL}, q as (select id, domain, avg(case when view in (2, 3) then correct::int end) - avg(case when view in (0, 1) then correct::int end) d from preds group by id, domain),
    m as (select domain, avg(d) d from q group by domain) select round(avg(d), 9) as estimate from m""",
)
def bootstrap_estimate(spark, sf_dir):
    return _question_deltas(spark, sf_dir).groupBy("domain").agg(F.avg("delta").alias("d")).agg(F.round(F.avg("d"), 9).alias("estimate"))


@query("views_per_question", f"with {VIEWS_SQL}, c as (select id, count(*) n from views group by id) select round(avg(n), 6) as mean_views, bool_and(n = 4) as all_four from c")
def views_per_question(spark, sf_dir):
    c = views(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.round(F.avg("n"), 6).alias("mean_views"), F.bool_and(F.col("n") == 4).alias("all_four"))


_LOST = sql_int("sha256('anchor:' || id)")
_ANCHOR_SQL = f"""{VIEWS_SQL}, o as (select id, view, p, (view % 2 = 0 or {_LOST} % 7 <> 0) as same from views),
rep as (select id, round(p[1], 9) as p0 from o where view = 3), anc as (select id, count(*) n, min(round(p[1], 9)) p0 from o where view = 0 and {_LOST} % 10 <> 0 group by id),
att as (select rep.id, coalesce(n, 0) as attached_rows, n is not null and {_LOST.replace('id)', 'rep.id)')} % 7 <> 0 as same_order, anc.p0 as anchor_p0, rep.p0 from rep left join anc using (id))"""


def _anchored(spark, sf_dir):
    """Replay rows and anchors, some anchors lost and some given in another order."""
    h = K.hash_int(K.order_key("anchor", F.col("id")))
    v = views(spark, sf_dir)
    order = F.when((F.col("view") != 0) & (h % 7 == 0), "3210").otherwise("0123").alias("option_order")
    anchors = v.where("view = 0").where(h % 10 != 0).select("id", order, F.round(F.element_at("p", 1), 9).alias("anchor_p0"))
    replay = v.where("view = 3").select("id", order, F.round(F.element_at("p", 1), 9).alias("p0"))
    return joins.attach_one(replay, anchors, "id", "option_order", ["anchor_p0"])


@query("anchor_attachment", f"with {_ANCHOR_SQL} select id, attached_rows, same_order, anchor_p0, p0 from att")
def anchor_attachment(spark, sf_dir):
    """The anchor posterior of each replay row; rows without exactly one stay and are counted."""
    return _anchored(spark, sf_dir).select("id", "attached_rows", "same_order", "anchor_p0", "p0")


@query(
    "anchor_coverage",
    f"""with {_ANCHOR_SQL} select count(*) as rows, count(*) filter (where attached_rows <> 1) as not_one, count(*) filter (where attached_rows = 1 and not same_order) as other_order,
    count(*) filter (where attached_rows <> 1 or not same_order) = 0 as passed from att""",
)
def anchor_coverage(spark, sf_dir):
    return joins.covered(_anchored(spark, sf_dir))


@query("question_lengths", "select min(length(question))::int as shortest, round(avg(length(question)), 6) as mean, max(length(question))::int as longest from (select distinct id, question from zagreus_exam_bank_v1)")
def question_lengths(spark, sf_dir):
    rows = read_table(spark, sf_dir, "zagreus_exam_bank_v1").select("id", "question").distinct()
    return G.lengths(rows, "question").withColumn("mean", F.round("mean", 6))


@query("counts_by_level", f"with {ITEMS_SQL} select domain, source_split, count(*) as n from items group by grouping sets ((), (domain), (source_split))")
def counts_by_level(spark, sf_dir):
    return G.total_and_by(items(spark, sf_dir), "domain", "source_split")


@query(
    "conditional_counts",
    f"""with {ITEMS_SQL} select count(*) as seen, count(*) filter (where len(options) = 4) as four_options, count(*) filter (where gold is null) as no_gold,
    count(*) filter (where source_split = 'pilot_train' and native_free) as training from (select *, true as native_free from items)""",
)
def conditional_counts(spark, sf_dir):
    return items(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.size("options") == 4).alias("four_options"), F.count_if(F.col("gold").isNull()).alias("no_gold"),
        F.count_if(F.col("source_split") == "pilot_train").alias("training"),
    )


@query(
    "collapsed_duplicates",
    f"""with b as (select distinct id, source_member, {sql_fold('question')} || chr(30) || coalesce(array_to_string(list_sort([{sql_fold('o')} for o in options]), chr(31)), '') k from zagreus_exam_bank_v1 where question is not null),
    r as (select id, source_member, min(id) over (partition by k) rep, count(*) over (partition by k) as rows from b) select id, source_member, rep, rows from r where rows > 1""",
)
def collapsed_duplicates(spark, sf_dir):
    """Rows of repeated content keys with their representative and the number of rows."""
    rows = read_table(spark, sf_dir, "zagreus_exam_bank_v1").where("question is not null").select("id", "source_member", "question", "options").distinct()
    rows = rows.withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
    keyed = rows.select("id", "source_member", K.record_key(F.col("question"), F.col("options")).alias("key"))
    return G.collapse(keyed, "key")[1].where("rows > 1").select("id", "source_member", "rep", "rows")


@query(
    "exact_dup_groups",
    f"with k as (select doc_id, sha256({sql_fold('text')}) h from documents where text is not null) select min(doc_id) as first_doc, count(*) as copies from k group by h having count(*) > 1",
)
def exact_dup_groups(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", K.question_hash(F.col("text")).alias("h"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("first_doc", "copies")


_KEYED_SQL = f"{VALID_SQL}, k as (select id, domain, gold, {sql_fold('question')} q, {sql_fold('options[gold + 1]')} g from valid)"


@query("key_conflicts", f"with {_KEYED_SQL} select sha256(q) as h, count(distinct g) as values, count(*) as rows from k group by q having count(distinct g) > 1")
def key_conflicts(spark, sf_dir):
    from siftwright.functions.text import norm_fold

    rows = valid_items(spark, sf_dir).select(K.question_hash(F.col("question")).alias("h"), norm_fold(F.element_at("options", F.col("gold") + 1)).alias("g"))
    return G.key_conflicts(rows, "h", "g")


@query(
    "cross_domain_keys",
    f"""with k as (select domain, sha256({sql_fold('text')}) h from documents where text is not null)
    select h, count(distinct domain) as values, count(*) as rows from k group by h having count(distinct domain) > 1""",
)
def cross_domain_keys(spark, sf_dir):
    """Texts that stand in more than one domain."""
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select(K.question_hash(F.col("text")).alias("h"), "domain")
    return G.key_conflicts(rows, "h", "domain")


@query("group_size_distribution", f"with {ITEMS_SQL}, s as (select group_id, count(*) size from items where group_id is not null group by group_id) select size, count(*) as groups from s group by size")
def group_size_distribution(spark, sf_dir):
    return G.group_sizes(items(spark, sf_dir), "group_id")


@query("distinct_counts", f"with {ITEMS_SQL} select count(*) as rows, count(distinct id) as distinct_id, count(distinct group_id) as distinct_group_id, count(distinct question) as distinct_question from items")
def distinct_counts(spark, sf_dir):
    return G.distinct_report(items(spark, sf_dir), "id", "group_id", "question")


@query("word_index", f"with {VALID_SQL}, w as (select domain, id, unnest(options) o, unnest(range(4)) = gold as r from valid) select domain, o as word, count(distinct id) as items, count(distinct id) filter (where r) as right_in from w group by domain, o")
def word_index(spark, sf_dir):
    """Words of each class of items, one row per word, with the items that hold it and those it answers."""
    spread = valid_items(spark, sf_dir).select("domain", "id", "gold", F.posexplode("options").alias("at", "word"))
    return G.word_index(spread.withColumn("right", F.col("at") == F.col("gold")), ["domain"], "word", "id")


_SUMMARY_SQL = f"""{VIEWS_SQL}, e as (select id, any_value(domain) domain, any_value(gold) gold, count(*) filter (where prediction = gold) votes,
  [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4])] m from preds group by id)"""


@query(
    "teacher_summary",
    f"""with {_SUMMARY_SQL} select coalesce(domain, '') as domain, count(*) as rows, count(*) filter (where votes >= 3 and round(m[gold + 1], 9) >= 0.35) as eligible,
    round(avg((votes >= 3 and round(m[gold + 1], 9) >= 0.35)::int), 9) as eligible_rate, round(avg((list_position([round(x, 9) for x in m], list_max([round(x, 9) for x in m])) - 1 = gold)::int), 9) as ensemble_accuracy,
    round(avg(m[gold + 1]), 8) as mean_p_gold from e group by grouping sets ((), (domain))""",
)
def teacher_summary(spark, sf_dir):
    """Per domain and in total (empty domain): eligible rows, ensemble accuracy and mean probability of the gold option."""
    p = predictions(spark, sf_dir)
    means = [F.round(F.avg(F.element_at("p", k + 1)), 9) for k in range(4)]
    per = p.groupBy("id", "domain", "gold").agg(F.count_if("correct").alias("votes"), F.array(*means).alias("m"))
    return G.teacher_summary(per)


@query("labelled_share_by_domain", f"with {VIEWS_SQL} select domain, round(avg(correct::int), 9) as accuracy, round(avg(p[gold + 1]), 8) as mean_p_gold from preds group by domain")
def labelled_share_by_domain(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.groupBy("domain").agg(F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"), F.round(F.avg(F.element_at("p", F.col("gold") + 1)), 8).alias("mean_p_gold"))


@query("complete_rows", f"with {VIEWS_SQL}, s as (select * from views where {sql_int("sha256('seen:' || id || ':' || view)")} % 5 <> 0) select id, count(*) as views from s group by id having count(*) = 4")
def complete_rows(spark, sf_dir):
    """Rows all of whose views have arrived."""
    seen = views(spark, sf_dir).where(K.hash_int(K.order_key("seen", F.col("id"), F.col("view"))) % 5 != 0)
    return seen.groupBy("id").agg(F.count(F.lit(1)).alias("views")).where("views = 4")
