"""Queries of validity predicates, screens, exclusions, families and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions import keys as K
from siftwright.functions import text as X
from siftwright.operators import aggregates as G
from siftwright.operators import filters as P
from siftwright.operators import gates as V
from siftwright.operators import graph, joins, simjoin
from siftwright.plans.base import ITEMS_SQL, VALID_SQL, VIEWS_SQL, items, predictions, sql_fold, sql_int, sql_keep, valid_items, views
from siftwright.plans.registry import query
from siftwright.plans.texts import sql_words
from siftwright.session import Scratch, read_table

JACCARD, CONTAINMENT, COSINE, MIN_WORDS = 0.70, 0.80, 0.35, 8


def _document_words(spark, sf_dir):
    """``(id, tokens, lang)``: distinct content words, made once per document."""
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "lang", "text")
    return rows.select("id", "lang", F.array_distinct(X.content_words(X.norm_fold(F.col("text")))).alias("tokens"))


def _benchmark_words(spark, sf_dir):
    rows = read_table(spark, sf_dir, "benchmark").where("text is not null")
    return rows.select(F.col("item_id").alias("ref_id"), F.array_distinct(X.content_words(X.norm_fold(F.col("text")))).alias("tokens"))


_WORDS_SQL = f"""dw as (select doc_id, list_distinct({sql_words('text')}) w from documents where text is not null),
bw as (select item_id, list_distinct({sql_words('text')}) w from benchmark where text is not null),
de as (select doc_id, len(w) n, unnest(w) t from dw where len(w) >= {MIN_WORDS}), be as (select item_id, len(w) m, unnest(w) t from bw where len(w) >= {MIN_WORDS}),
hits as (select doc_id, item_id, count(*) c, any_value(n) n, any_value(m) m from de join be using (t) group by doc_id, item_id),
contained as (select doc_id, item_id, round(c / least(n, m), 9) as score from hits where c / least(n, m) >= {CONTAINMENT})"""


@query("containment_decontam", f"with {_WORDS_SQL} select * from contained")
def containment_decontam(spark, sf_dir):
    """Documents that contain four fifths of the content words of a protected item, or the other way round."""
    found = simjoin.reference_matches(_document_words(spark, sf_dir), _benchmark_words(spark, sf_dir), "containment", CONTAINMENT, MIN_WORDS)
    return found.select(F.col("id").alias("doc_id"), F.col("ref_id").alias("item_id"), F.round("score", 9).alias("score"))


@query("decontam_survivors", f"with {_WORDS_SQL} select doc_id, lang, source from documents where doc_id not in (select doc_id from contained)")
def decontam_survivors(spark, sf_dir):
    bad = containment_decontam(spark, sf_dir).select("doc_id").distinct()
    return read_table(spark, sf_dir, "documents").join(bad, "doc_id", "left_anti").select("doc_id", "lang", "source")


def _shingles(rows, text):
    words = rows.withColumn("w", X.content_words(X.norm_fold(F.col(text))))
    return words.withColumn("tokens", X.word_shingles(F.col("w"))).drop("w", text)


# of a word list w, made in a subquery of its own
SHINGLES = "list_distinct(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] else w end)"


@query(
    "best_jaccard_match",
    f"""with {ITEMS_SQL}, q as (select id, source_split, {sql_words('question')} w from items where question is not null),
    a as (select id, {SHINGLES} s from q where source_split = 'pilot_train'), b as (select id ref_id, {SHINGLES} s from q where source_split <> 'pilot_train'),
    ae as (select id, len(s) n, unnest(s) t from a), be as (select ref_id, len(s) m, unnest(s) t from b),
    h as (select id, ref_id, count(*) c, any_value(n) n, any_value(m) m from ae join be using (t) group by id, ref_id),
    s as (select id, ref_id, c / (n + m - c) as score from h where c / (n + m - c) >= {JACCARD}),
    r as (select *, row_number() over (partition by id order by score desc, ref_id) k from s) select id, ref_id, round(score, 9) as score from r where k = 1""",
)
def best_jaccard_match(spark, sf_dir):
    """For each training item the held-out item with the highest shingle Jaccard, ties to the lowest id."""
    rows = items(spark, sf_dir).where("question is not null")
    train = _shingles(rows.where("source_split = 'pilot_train'").select("id", "question"), "question")
    held = _shingles(rows.where("source_split <> 'pilot_train'").select(F.col("id").alias("ref_id"), "question"), "question")
    found = simjoin.reference_matches(train, held, "jaccard", JACCARD, best=True)
    return found.select("id", "ref_id", F.round("score", 9).alias("score"))


def _near(spark, sf_dir):
    """Within a language; documents without one are a class of their own, shown as an empty language."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    docs = _shingles(docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), "text"), "text")
    return simjoin.jaccard_pairs(docs.select("id", "lang", "tokens"), JACCARD, ["lang"], spark)


_NEAR_SQL = f"""ws as (select doc_id, coalesce(lang, '') as lang, {sql_words('text')} w from documents where text is not null),
ss as (select doc_id, lang, {SHINGLES} s from ws), sh as (select doc_id, lang, array_to_string(list_sort(s), chr(31)) k, s from ss),
mem as (select doc_id, lang, min(doc_id) over (partition by lang, k) rep, s from sh where len(s) > 0),
reps as (select doc_id, lang, len(s) n, unnest(s) t from mem where doc_id = rep),
ph as (select a.doc_id a, b.doc_id b, any_value(a.lang) lang, count(*) c, any_value(a.n) n, any_value(b.n) m from reps a join reps b on a.t = b.t and a.lang = b.lang and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
near as (select a, b, lang, round(c / (n + m - c), 9) as score from ph where c / (n + m - c) >= {JACCARD})"""


@query("near_dup_pairs", f"with {_NEAR_SQL} select * from near")
def near_dup_pairs(spark, sf_dir):
    """Pairs of representatives of equal shingle sets, within a language."""
    return _near(spark, sf_dir)[0].select("a", "b", "lang", F.round("score", 9).alias("score"))


@query("near_dup_members", f"with {_NEAR_SQL} select doc_id, rep, lang from mem")
def near_dup_members(spark, sf_dir):
    return _near(spark, sf_dir)[1].select(F.col("id").alias("doc_id"), "rep", "lang")


def _families(spark, sf_dir):
    pairs, members = _near(spark, sf_dir)
    edges = pairs.select("a", "b").union(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    return graph.connected_components(edges, spark)


_FAMILY_SQL = f"""{_NEAR_SQL}, e as (select a, b from near union select rep, doc_id from mem where doc_id <> rep), sym as (select a, b from e union select b, a from e),
walk(id, root) as (select a, a from sym union select b.b, w.root from walk w join sym b on b.a = w.id), fam as (select id, min(root) root from walk group by id)"""


@query("near_dup_families", f"with recursive {_FAMILY_SQL} select id as doc_id, root from fam")
def near_dup_families(spark, sf_dir):
    return _families(spark, sf_dir).select(F.col("id").alias("doc_id"), "root")


@query(
    "family_ids",
    f"""with recursive {_FAMILY_SQL}, p as (select doc_id, coalesce(root, doc_id) r from documents left join fam on id = doc_id),
    h as (select r, substr(sha256(doc_id::varchar), 1, 3) b, sha256(array_to_string(list_sort(list(doc_id::varchar)), chr(10))) part from p group by 1, 2),
    g as (select r, sha256(array_to_string(list_sort(list(b || part)), chr(10))) group_id from h group by r) select doc_id, group_id from p join g using (r)""",
)
def family_ids(spark, sf_dir):
    ids = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return graph.family_ids(ids, _families(spark, sf_dir)).select(F.col("id").alias("doc_id"), "group_id")


@query("family_sizes", f"with recursive {_FAMILY_SQL}, s as (select root, count(*) size from fam group by root) select size, count(*) as groups from s group by size")
def family_sizes(spark, sf_dir):
    return G.group_sizes(_families(spark, sf_dir), "root")


@query(
    "family_propagated_removal",
    f"""with recursive {_FAMILY_SQL}, v as (select doc_id, coalesce(root, doc_id) r, case when {sql_int("sha256('verdict:' || doc_id)")} % 10 = 0 then 'match' else 'distinct' end verdict
      from documents left join fam on id = doc_id)
    select doc_id, verdict from v where r not in (select r from v where verdict = 'match')""",
)
def family_propagated_removal(spark, sf_dir):
    """One member with a match verdict takes its whole family out; undecided rows count as distinct."""
    ids = read_table(spark, sf_dir, "documents").select("doc_id")
    placed = ids.join(_families(spark, sf_dir).withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    decided = ids.where(K.hash_int(K.order_key("verdict", F.col("doc_id"))) % 10 == 0).withColumn("verdict", F.lit("match"))
    rows = Scratch(spark, "verdicts").cut(joins.overlay(placed, decided, ["doc_id"], "verdict", "distinct"))
    return P.remove_families(rows, rows.where("verdict = 'match'"), "root").select("doc_id", "verdict")


@query(
    "containment_pairs",
    f"""with {VALID_SQL}, w as (select id, domain, list_sort(list_distinct({sql_words('question')})) w from valid), m as (select id, domain, w, min(id) over (partition by domain, w) rep from w),
    r as (select id, domain, len(w) n, unnest(w) t from m where id = rep and len(w) >= {MIN_WORDS}),
    h as (select a.id a, b.id b, any_value(a.domain) domain, count(*) c, any_value(a.n) n, any_value(b.n) m from r a join r b on a.domain = b.domain and a.t = b.t and a.id < b.id group by a.id, b.id)
    select a, b, domain, round(c / least(n, m), 9) as score from h where c / least(n, m) >= {CONTAINMENT}""",
)
def containment_pairs(spark, sf_dir):
    """Pairs of items of a domain of which one question's content words contain the other's."""
    rows = valid_items(spark, sf_dir).select("id", "domain", F.array_distinct(X.content_words(X.norm_fold(F.col("question")))).alias("tokens"))
    pairs = simjoin.containment_pairs(rows, CONTAINMENT, MIN_WORDS, ["domain"], spark)[0]
    return pairs.select("a", "b", "domain", F.round("score", 9).alias("score"))


@query(
    "item_families",
    f"""with recursive {VALID_SQL}, w as (select id, domain, {sql_fold('question')} q, {sql_words('question')} w from valid),
    s as (select id, domain, q, list_distinct(w) c, {SHINGLES} s from w),
    se as (select id, domain, len(s) n, unnest(s) t from s), ce as (select id, domain, len(c) n, unnest(c) t from s where len(c) >= {MIN_WORDS}),
    j as (select a.id a, b.id b from se a join se b on a.domain = b.domain and a.t = b.t and a.id < b.id group by a.id, b.id having count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= {JACCARD}),
    k as (select a.id a, b.id b from ce a join ce b on a.domain = b.domain and a.t = b.t and a.id < b.id group by a.id, b.id having count(*) / least(any_value(a.n), any_value(b.n)) >= {CONTAINMENT}),
    e as (select a, b from j union select a, b from k union select min(id) over (partition by domain, q), id from s), sym as (select a, b from e where a <> b union select b, a from e where a <> b),
    walk(id, root) as (select a, a from sym union select b.b, w.root from walk w join sym b on b.a = w.id) select id, min(root) as root from walk group by id""",
)
def item_families(spark, sf_dir):
    """Families of items of a domain: equal questions, shingle Jaccard and word containment, closed transitively."""
    rows = valid_items(spark, sf_dir).select("id", "domain", X.norm_fold(F.col("question")).alias("q"))
    rows = rows.withColumn("w", X.content_words(F.col("q")))
    rows = Scratch(spark, "items").cut(rows.select("id", "domain", "q", X.word_shingles(F.col("w")).alias("s"), F.array_distinct("w").alias("c")))
    first = rows.groupBy("domain", "q").agg(F.min("id").alias("a"))
    edges = rows.join(first, ["domain", "q"]).where("a <> id").select("a", F.col("id").alias("b"))
    screens = (simjoin.jaccard_pairs(rows.select("id", "domain", F.col("s").alias("tokens")), JACCARD, ["domain"], spark),
               simjoin.containment_pairs(rows.select("id", "domain", F.col("c").alias("tokens")), CONTAINMENT, MIN_WORDS, ["domain"], spark))
    for pairs, members in screens:
        edges = edges.union(pairs.select("a", "b")).union(members.where("id <> rep").select("rep", "id"))
    return graph.connected_components(edges, spark)


_VEC = "e as (select vec_id, label, [x::double for x in embedding] v, sqrt(list_sum([x::double * x::double for x in embedding])) n from embeddings)"


@query(
    "nearest_vector",
    f"""with {_VEC}, s as (select q.vec_id query_id, r.vec_id id, list_inner_product(q.v, r.v) / (q.n * r.n) score from e q join e r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0),
    k as (select *, row_number() over (partition by query_id order by score desc, id) k from s) select query_id, id, round(score, 7) as score from k where k = 1""",
)
def nearest_vector(spark, sf_dir):
    """The best row for each query vector (ids divisible by 100), over all rows."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return simjoin.cosine_hits(rows, rows.where("id % 100 = 0"), None).withColumn("score", F.round("score", 7))


@query(
    "cosine_pairs",
    f"""with {_VEC} select q.vec_id query_id, r.vec_id id, round(list_inner_product(q.v, r.v) / (q.n * r.n), 7) as score from e q join e r on q.vec_id <> r.vec_id
    where q.vec_id % 100 = 0 and list_inner_product(q.v, r.v) / (q.n * r.n) >= {COSINE}""",
)
def cosine_pairs(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return simjoin.cosine_hits(rows, rows.where("id % 100 = 0"), COSINE).withColumn("score", F.round("score", 7))


@query(
    "cosine_pairs_same_label",
    f"""with {_VEC} select q.vec_id query_id, r.vec_id id, round(list_inner_product(q.v, r.v) / (q.n * r.n), 7) as score from e q join e r on q.vec_id <> r.vec_id and q.label = r.label
    where q.vec_id % 100 = 0 and list_inner_product(q.v, r.v) / (q.n * r.n) >= 0.1""",
)
def cosine_pairs_same_label(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return simjoin.cosine_hits(rows, rows.where("id % 100 = 0"), 0.1, "label").withColumn("score", F.round("score", 7))


@query("accepted_items", f"with {VALID_SQL} select id, domain from valid")
def accepted_items(spark, sf_dir):
    return valid_items(spark, sf_dir).select("id", "domain")


_REASONS_SQL = f"""{ITEMS_SQL}, k as (select *, [{sql_keep('o')} for o in options] ks from items),
f as (select id, [x for x in [
  case when trim(coalesce(group_id, ''), ' ') = '' then 'missing_group' end, case when trim(coalesce(domain, ''), ' ') = '' then 'missing_domain' end,
  case when trim(coalesce(question, ''), ' ') = '' then 'missing_question' end, case when coalesce(len(options), -1) <> 4 then 'option_count' end,
  case when list_contains(ks, '') then 'empty_option' end, case when len(list_distinct(ks)) < len(ks) then 'repeated_option' end,
  case when gold is null or gold not between 0 and 3 then 'gold_out_of_range' end] if x is not null] rs from k)"""


@query("reject_reasons", f"with {_REASONS_SQL}, u as (select unnest(rs) reason from f) select reason, count(*) as rows from u group by reason")
def reject_reasons(spark, sf_dir):
    return P.reason_counts(P.quarantine(items(spark, sf_dir), P.item_reasons())[1])


@query("first_reject_reasons", f"with {_REASONS_SQL} select rs[1] as reason, count(*) as rows from f where len(rs) > 0 group by rs[1]")
def first_reject_reasons(spark, sf_dir):
    return P.reason_counts(P.quarantine(items(spark, sf_dir), P.item_reasons())[1], first_only=True)


@query("posterior_checks", f"with {VIEWS_SQL} select view, count(*) as rows, true as all_well_formed from views group by view")
def posterior_checks(spark, sf_dir):
    return views(spark, sf_dir).groupBy("view").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(P.posterior_ok(F.col("p"))).alias("all_well_formed"))


@query(
    "screen_triggers",
    f"""with {_WORDS_SQL}, b as (select doc_id, max(score) s from contained group by doc_id), x as (select distinct sha256({sql_fold('text')}) h from benchmark),
    d as (select doc_id, sha256({sql_fold('text')}) h from documents)
    select doc_id, 'content_word_containment' as kind, s as score from b union all select doc_id, 'normalised_exact', 1.0::double from d where h in (select h from x)""",
)
def screen_triggers(spark, sf_dir):
    """Every screen that fires on a document, with its score."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", K.question_hash(F.col("text")).alias("h"))
    exact = joins.member_of(docs, read_table(spark, sf_dir, "benchmark").select(K.question_hash(F.col("text")).alias("h")), "h").select("doc_id").withColumn("exact", F.lit(True))
    best = containment_decontam(spark, sf_dir).groupBy("doc_id").agg(F.max("score").alias("contained"))
    both = docs.select("doc_id").join(exact, "doc_id", "left").join(best, "doc_id", "left")
    fired = P.triggers(("normalised_exact", F.coalesce("exact", F.lit(False)), F.lit(1.0)), ("content_word_containment", F.col("contained").isNotNull(), F.col("contained")))
    return both.select("doc_id", F.explode(fired).alias("t")).select("doc_id", "t.kind", "t.score")


_ELIGIBLE_SQL = f"""{VIEWS_SQL}, e as (select id, gold, count(*) filter (where correct) votes, avg(p[gold + 1]) pg from preds group by id, gold)"""


@query("eligible_items", f"with {_ELIGIBLE_SQL} select id, votes >= 3 and pg >= 0.35 as eligible from e")
def eligible_items(spark, sf_dir):
    rows = predictions(spark, sf_dir).groupBy("id", "gold").agg(F.collect_list("prediction").alias("tops"), F.avg(F.element_at("p", F.col("gold") + 1)).alias("pg"))
    return rows.select("id", P.eligible(F.col("tops"), F.col("gold"), F.col("pg")).alias("eligible"))


@query(
    "authorised_and_anchor_rows",
    f"""with {ITEMS_SQL}, m as (select id, source_split, gold, {sql_int("sha256('auth:' || id)")} % 3 <> 0 as ok, case when {sql_int("sha256('anchor:' || id)")} % 4 = 0 then true end as anchor_replay from items)
    select id, ok and gold is not null as authorised, coalesce(anchor_replay, source_split = 'pilot_train', false) as anchor from m""",
)
def authorised_and_anchor_rows(spark, sf_dir):
    rows = items(spark, sf_dir).select(
        "id", F.when(F.col("source_split") == "pilot_train", "unassigned").otherwise(F.col("source_split")).alias("source_split"), F.col("gold").alias("campaign_gold"),
        (K.hash_int(K.order_key("auth", F.col("id"))) % 3 != 0).alias("gold_ce_authorized"),
        F.when(K.hash_int(K.order_key("anchor", F.col("id"))) % 4 == 0, F.lit(True)).alias("anchor_replay"),
    )
    yes = P.authorised(rows).select("id", F.lit(True).alias("a"))
    return rows.join(yes, "id", "left").select("id", F.coalesce("a", F.lit(False)).alias("authorised"), P.anchor_rows(rows).alias("anchor"))


@query(
    "exact_membership",
    f"""with b as (select distinct {sql_fold('question')} k from zagreus_exam_bank_v1), {ITEMS_SQL}
    select id, source_split from items where {sql_fold('question')} in (select k from b)""",
)
def exact_membership(spark, sf_dir):
    """Items whose normalised question stands in the exam bank."""
    bank = read_table(spark, sf_dir, "zagreus_exam_bank_v1").select(K.question_hash(F.col("question")).alias("h"))
    rows = items(spark, sf_dir).select("id", "source_split", K.question_hash(F.col("question")).alias("h"))
    return joins.member_of(rows, bank, "h").select("id", "source_split")


@query(
    "three_key_exclusion",
    f"""with {ITEMS_SQL}, k as (select id, group_id, sha256({sql_fold('question')}) h, source_split from items), x as (select * from k where source_split <> 'pilot_train')
    select id from k where source_split = 'pilot_train' and id not in (select id from x where id is not null) and (group_id is null or group_id not in (select group_id from x where group_id is not null))
      and (h is null or h not in (select h from x where h is not null))""",
)
def three_key_exclusion(spark, sf_dir):
    """Training items that share neither id, group nor question with an evaluation split."""
    rows = items(spark, sf_dir).select("id", "group_id", K.question_hash(F.col("question")).alias("h"), "source_split")
    return joins.exclude_any(rows.where("source_split = 'pilot_train'"), rows.where("source_split <> 'pilot_train'"), ["id", "group_id", "h"]).select("id")


@query(
    "matched_reference_lookup",
    f"""with r as (select {sql_fold('question')} k, max(id) ref_id from zagreus_exam_bank_v1 group by 1), {ITEMS_SQL} select id, ref_id from items join r on {sql_fold('question')} = k""",
)
def matched_reference_lookup(spark, sf_dir):
    bank = read_table(spark, sf_dir, "zagreus_exam_bank_v1").select(K.question_hash(F.col("question")).alias("h"), F.col("id").alias("ref_id"), F.col("id").alias("o"))
    rows = items(spark, sf_dir).select("id", K.question_hash(F.col("question")).alias("h"))
    return joins.lookup_last(rows, bank, "h", "o", "ref_id").select("id", "ref_id")


@query(
    "decision_overlay",
    """with d as (select pair_id, min(verdict) verdict from exam_match_pairs group by pair_id)
    select pair_id, case when pair_id % 3 = 0 then coalesce(verdict, 'distinct') else 'distinct' end as verdict from d""",
)
def decision_overlay(spark, sf_dir):
    """Verdicts laid over all pairs, undecided ones as distinct."""
    pairs = read_table(spark, sf_dir, "exam_match_pairs").groupBy("pair_id").agg(F.min("verdict").alias("verdict"))
    return joins.overlay(pairs.select("pair_id"), pairs.where("pair_id % 3 = 0"), ["pair_id"], "verdict", "distinct")


@query(
    "id_conservation",
    """with b as (select id, count(*) n from zagreus_final_instrument group by id), a as (select id, count(*) n from zagreus_final_instrument where domain is not null group by id)
    select count(*) filter (where a.id is null) as lost, count(*) filter (where b.id is null) as gained, count(*) filter (where coalesce(b.n, 1) > 1 or coalesce(a.n, 1) > 1) as repeated
    from b full join a using (id)""",
)
def id_conservation(spark, sf_dir):
    rows = read_table(spark, sf_dir, "zagreus_final_instrument")
    return joins.conservation(rows.select("id"), rows.where("domain is not null").select("id"), "id")


@query(
    "circular_donors",
    f"""with {VALID_SQL}, d as (select item_id, domain, row_number() over (order by item_id) - 1 pos, count(*) over () n from benchmark where domain is not null),
    s as (select id, domain, ({sql_int("sha256('donor:' || id)")}) h from valid), w as (select s.id, d.item_id, row_number() over (partition by s.id order by (d.pos - s.h % d.n + d.n) % d.n) k
      from s join d on d.domain <> s.domain) select id, item_id as donor_id from w where k = 1""",
)
def circular_donors(spark, sf_dir):
    """The first held-out item of another domain, walking round from a hashed start."""
    donors = read_table(spark, sf_dir, "benchmark").where("domain is not null").select(F.col("item_id").alias("donor_id"), F.col("domain").alias("donor_group"))
    return joins.circular_donor(valid_items(spark, sf_dir).select("id", F.col("domain").alias("group_id")), donors, "donor")


@query(
    "peer_values",
    """with v as (select distinct source, domain from zagreus_final_instrument where source is not null and domain is not null)
    select a.source, a.domain, coalesce(string_agg(b.domain, ',' order by b.domain), '') as peers from v a left join v b on a.source = b.source and a.domain <> b.domain group by a.source, a.domain""",
)
def peer_values(spark, sf_dir):
    rows = read_table(spark, sf_dir, "zagreus_final_instrument").where("source is not null and domain is not null")
    return joins.peers(rows, ["source"], "domain").select("source", "domain", F.array_join("peers", ",").alias("peers"))


_OVERLAP = "select k as key, array_to_string(list_sort(list(distinct source_split)), ',') as splits from t where source_split is not null group by k having count(distinct source_split) > 1"


@query("split_group_overlap", f"with {ITEMS_SQL}, t as (select group_id k, source_split from items where group_id is not null) {_OVERLAP}")
def split_group_overlap(spark, sf_dir):
    found = joins.split_overlap(items(spark, sf_dir).where("source_split is not null"), "group_id", "source_split")
    return found.select("key", F.array_join("splits", ",").alias("splits"))


@query("split_question_overlap", f"with {ITEMS_SQL}, t as (select sha256({sql_fold('question')}) k, source_split from items where question is not null) {_OVERLAP}")
def split_question_overlap(spark, sf_dir):
    rows = items(spark, sf_dir).where("source_split is not null and question is not null")
    return joins.split_overlap(rows, K.question_hash(F.col("question")), "source_split").select("key", F.array_join("splits", ",").alias("splits"))


@query("pending_rows", "select doc_id from documents where doc_id not in (select item_id from benchmark)")
def pending_rows(spark, sf_dir):
    done = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return joins.pending(read_table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


@query("set_operations", "select lang, count(*) as n from (select lang from documents intersect select lang from documents where doc_id % 2 = 0) group by lang")
def set_operations(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("lang").intersect(docs.where("doc_id % 2 = 0").select("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bag_union_and_difference",
    """with a as (select domain, lang from documents union all select domain, null from benchmark), b as (select domain, lang from documents)
    select domain, lang, count(*) as n from (select * from a except all select * from b) group by domain, lang""",
)
def bag_union_and_difference(spark, sf_dir):
    docs, bench = read_table(spark, sf_dir, "documents").select("domain", "lang"), read_table(spark, sf_dir, "benchmark").select("domain")
    both = docs.unionByName(bench, allowMissingColumns=True)
    return both.exceptAll(docs).groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tail_packet",
    f"""with {_WORDS_SQL}, s as (select doc_id, item_id, round(c / least(n, m), 9) as score from hits where c / least(n, m) >= 0.5),
    t as (select *, row_number() over (order by score desc, doc_id, item_id) r from s)
    select r::int as rank, doc_id as candidate_id, item_id as matched_id, score, case when doc_id % 7 = 0 then 'distinct' else 'pending' end as verdict from t where r <= 300""",
)
def tail_packet(spark, sf_dir):
    """The 300 closest surviving pairs with earlier verdicts, without their texts."""
    found = simjoin.reference_matches(_document_words(spark, sf_dir), _benchmark_words(spark, sf_dir), "containment", 0.5, MIN_WORDS)
    scored = found.select(F.col("id").alias("candidate_id"), F.col("ref_id").alias("matched_id"), F.round("score", 9).alias("score"), F.lit("").alias("text"))
    scored = Scratch(spark, "tail").cut(scored)
    decided = scored.where("candidate_id % 7 = 0").orderBy(F.desc("score"), "candidate_id", "matched_id").limit(300)  # the packet of the round before, adjudicated
    return V.audit_packet(scored, 300, decided.select("candidate_id", "matched_id", F.lit("distinct").alias("verdict")))[1]


@query(
    "gate_report",
    f"""with {_WORDS_SQL}, {VALID_SQL}, c as (select 'unique_ids' as name, count(*) = count(distinct id) as ok from valid union all
      select 'no_containment_left', (select count(*) from contained) = 0 union all select 'four_options', bool_and(len(options) = 4) from valid union all
      select 'low_removal_rate', (select count(distinct doc_id) from contained) / (select count(*) from documents) <= 0.05) select name, ok from c""",
)
def gate_report(spark, sf_dir):
    checks = V.check_table(spark, valid_items(spark, sf_dir), unique_ids=F.count(F.lit(1)) == F.countDistinct("id"), four_options=F.bool_and(F.size("options") == 4))
    hits = Scratch(spark, "gate").cut(containment_decontam(spark, sf_dir).select("doc_id").distinct())
    docs = read_table(spark, sf_dir, "documents").select("doc_id").join(hits.withColumn("hit", F.lit(True)), "doc_id", "left")
    more = V.check_table(spark, docs, no_containment_left=F.count_if("hit") == 0, low_removal_rate=F.count_if("hit") / F.count(F.lit(1)) <= 0.05)
    return checks.unionByName(more)


@query("gate_verdict", f"with {VALID_SQL}, c as (select count(*) = count(distinct id) as ok from valid) select ok as passed, (case when ok then 0 else 1 end)::bigint as failed from c")
def gate_verdict(spark, sf_dir):
    return V.gate(V.check_table(spark, valid_items(spark, sf_dir), unique_ids=F.count(F.lit(1)) == F.countDistinct("id")))


@query(
    "mechanical_recheck",
    f"""with {_WORDS_SQL}, kept as (select 'decontaminated' as stage, doc_id, text from documents where doc_id not in (select doc_id from contained)
      union all select 'adjudicated', doc_id, text from documents where {sql_int("sha256('verdict:' || doc_id)")} % 10 <> 0),
    kw as (select stage, doc_id, text, list_distinct({sql_words('text')}) w from kept where text is not null),
    ke as (select stage, doc_id, len(w) n, unnest(w) t from kw where len(w) >= {MIN_WORDS}),
    found as (select stage, doc_id, count(*) / least(any_value(n), any_value(m)) as score from ke join be using (t) group by stage, doc_id, item_id),
    best as (select stage, max(score) score, count(distinct doc_id) filter (where score >= {CONTAINMENT}) as still_found from found group by stage),
    same as (select stage, count(*) exact from kw where {sql_fold('text')} in (select {sql_fold('text')} from benchmark where text is not null) group by stage)
    select stage, coalesce(still_found, 0) as still_found, coalesce(exact, 0) as exact, round(coalesce(score, 0), 9) as highest
    from (select unnest(['decontaminated', 'adjudicated']) as stage) left join best using (stage) left join same using (stage)""",
)
def mechanical_recheck(spark, sf_dir):
    """The screens run again on what two stages kept: the survivors of the screen, and of verdicts that know nothing of it."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    bad = containment_decontam(spark, sf_dir).select("doc_id").distinct()
    verdict = K.hash_int(K.order_key("verdict", F.col("doc_id"))) % 10 != 0
    stages = {"decontaminated": docs.join(bad, "doc_id", "left_anti"), "adjudicated": docs.where(verdict)}
    out = None
    for name, kept in stages.items():
        one = recheck(kept.select(F.col("doc_id").alias("id"), "text"), read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), "text"))
        one = one.select(F.lit(name).alias("stage"), "still_found", "exact", F.round("highest", 9).alias("highest"))
        out = one if out is None else out.unionByName(one)
    return out


def recheck(kept, references):
    """Of ``kept (id, text)`` against ``references (ref_id, text)``: rows the containment screen finds, rows equal
    but for writing, and the highest containment."""
    fold = lambda rows, key: rows.where("text is not null").select(key, X.norm_fold(F.col("text")).alias("f"))
    a, b = fold(kept, "id"), fold(references, "ref_id")
    word_sets = lambda rows, key: rows.select(key, F.array_distinct(X.content_words(F.col("f"))).alias("tokens"))
    scored = simjoin.reference_matches(word_sets(a, "id"), word_sets(b, "ref_id"), "containment", 0.0, MIN_WORDS)
    best = scored.groupBy("id").agg(F.max("score").alias("score"))
    found = best.agg(F.count_if(F.col("score") >= CONTAINMENT).alias("still_found"), F.coalesce(F.max("score"), F.lit(0.0)).alias("highest"))
    return found.crossJoin(joins.member_of(a, b, "f").agg(F.count(F.lit(1)).alias("exact")))  # one row by one row
