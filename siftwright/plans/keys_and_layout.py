"""Queries of keys, permutations, option layouts and probability vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions import arrays as A
from siftwright.functions import keys as K
from siftwright.functions.text import display_lines
from siftwright.plans.base import ITEMS_SQL, VALID_SQL, VIEWS_SQL, items, sql_fold, sql_int, sql_keep, valid_items, views
from siftwright.plans.registry import query
from siftwright.session import read_table

def spread(array, n: int, digits: int = 8, name: str = "p"):
    """Array elements as rounded columns (nudged off exact halves, which engines round apart)."""
    return [F.round(F.element_at(array, k + 1) + 1e-11, digits).alias(f"{name}{k}") for k in range(n)]


def sql_spread(array: str, n: int, digits: int = 8, name: str = "p") -> str:
    return ", ".join(f"round(({array})[{k + 1}] + 1e-11, {digits}) as {name}{k}" for k in range(n))


PERMS = "[" + ", ".join(str(p) for p in A.PERMUTATIONS) + "]"


@query(
    "record_keys",
    f"""with {ITEMS_SQL} select id, sha256({sql_fold('question')}) as question_hash,
    sha256({sql_fold('question')} || chr(30) || array_to_string(list_sort([{sql_fold('o')} for o in options]), chr(31))) as record_key from items where options is not null""",
)
def record_keys(spark, sf_dir):
    rows = items(spark, sf_dir).where("options is not null")
    return rows.select("id", K.question_hash(F.col("question")).alias("question_hash"), K.record_key(F.col("question"), F.col("options")).alias("record_key"))


@query(
    "signature_groups",
    f"""with {VALID_SQL}, s as (select id, {sql_keep('context')} c, {sql_keep('question')} q, list_sort([{sql_keep('o')} for o in options]) o from valid)
    select min(id) as first_id, count(*) as rows from s group by c, q, o having count(*) > 1""",
)
def signature_groups(spark, sf_dir):
    rows = valid_items(spark, sf_dir).select("id", K.signature(F.col("context"), F.col("question"), F.col("options")).alias("s"))
    return rows.groupBy("s").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("s")


@query("canonical_json_hashes")
def canonical_json_hashes(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rows.select("id", K.canonical_json_hash(question=F.col("question"), options=F.col("options"), gold=F.col("gold")).alias("prompt_sha256"))


@query(
    "seeded_order_and_buckets",
    f"""with {ITEMS_SQL}, h as (select id, sha256('order-1:' || id) h from items)
    select id, h as order_key, {sql_int('h')} as small, ({sql_int('h')} % 5)::int as bucket, (('0x' || substr(h, 1, 15))::BIGINT % 10)::int as wide_bucket from h""",
)
def seeded_order_and_buckets(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", K.order_key("order-1", F.col("id")).alias("order_key"))
    return rows.select("id", "order_key", K.hash_int(F.col("order_key")).alias("small"), K.hash_bucket(F.col("order_key"), 5).alias("bucket"),
                       K.hash_bucket(F.col("order_key"), 10, 15).alias("wide_bucket"))


@query(
    "permuted_prompts",
    f"""with {VALID_SQL}, o as (select id, options, {PERMS}[(({sql_int("sha256('other:' || id || ':1')")} % 23 + 1) % 24 + 1)::int] p from valid)
    select id, 'A. ' || options[p[1] + 1] || chr(10) || 'B. ' || options[p[2] + 1] || chr(10) || 'C. ' || options[p[3] + 1] || chr(10) || 'D. ' || options[p[4] + 1] as lines from o""",
)
def permuted_prompts(spark, sf_dir):
    rows = valid_items(spark, sf_dir).withColumn("p", A.other_order(F.col("id"), F.lit(1)))
    return rows.select("id", display_lines(F.col("options"), F.col("p")).alias("lines"))


@query(
    "view_orders",
    f"""with {VALID_SQL}, k as (select id, k, sha256('views:' || id || ':' || k) h from valid, range(1, 24) t(k)),
    r as (select id, k, row_number() over (partition by id order by h, k) n from k)
    select id, 0::int as view, '0,1,2,3' as ordering from valid union all select id, n::int, array_to_string({PERMS}[(k + 1)::int], ',') from r where n <= 3""",
)
def view_orders(spark, sf_dir):
    rows = valid_items(spark, sf_dir).select("id", F.posexplode(A.view_orders(F.col("id"))).alias("view", "o"))
    return rows.select("id", "view", F.array_join("o", ",").alias("ordering"))


@query(
    "inverse_permutation",
    f"""with {VIEWS_SQL}, o as (select *, {PERMS}[(({sql_int("sha256('other:' || id || ':' || view)")} % 23 + 1) % 24 + 1)::int] o from views)
    select id, view, {sql_spread('[p[list_position(o, s)] for s in [0, 1, 2, 3]]', 4)} from o""",
)
def inverse_permutation(spark, sf_dir):
    rows = views(spark, sf_dir).withColumn("o", A.other_order(F.col("id"), F.col("view")))
    return rows.select("id", "view", *spread(A.to_semantic(F.col("p"), F.col("o")), 4))


@query("twister_orders")
def twister_orders(spark, sf_dir):
    from pyspark.sql import types as T

    udf = F.pandas_udf(lambda ids: A.twister_orders(ids), T.ArrayType(T.ArrayType(T.IntegerType())))
    return valid_items(spark, sf_dir).select("id", udf("id").alias("orders"))


@query(
    "mean_posterior",
    f"""with {VIEWS_SQL}, m as (select id, gold, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4])] m from views group by id, gold)
    select id, round(m[1], 9) as p0, round(m[gold + 1], 9) as p_gold, (list_position([round(x, 12) for x in m], list_max([round(x, 12) for x in m])) - 1)::int as top1 from m""",
)
def mean_posterior(spark, sf_dir):
    rows = views(spark, sf_dir).groupBy("id", "gold").agg(*[F.avg(F.element_at("p", k + 1)).alias(f"m{k}") for k in range(4)])
    rows = rows.withColumn("m", A.renormalise(F.array("m0", "m1", "m2", "m3")))
    top = A.top1(F.transform("m", lambda x: F.round(x, 12)))
    return rows.select("id", F.round(F.element_at("m", 1), 9).alias("p0"), F.round(F.element_at("m", F.col("gold") + 1), 9).alias("p_gold"), top.alias("top1"))


@query(
    "exp_normalised",
    f"""with {VIEWS_SQL}, e as (select id, view, [exp(ln(x) - ln(list_max(p))) for x in p] e from views)
    select id, view, {sql_spread('[x / list_sum(e) for x in e]', 4)} from e""",
)
def exp_normalised(spark, sf_dir):
    logs = F.transform("p", lambda x: F.log(x))
    return views(spark, sf_dir).select("id", "view", *spread(A.exp_normalise(logs), 4))


@query(
    "three_option_layout",
    f"""with {VIEWS_SQL}, f as (select id, gold, p, [k for k in [0, 1, 2, 3] if k <> gold] free, {sql_int("sha256('drop:' || id)")} h from views where view = 0),
    d as (select id, p, [k for k in [0, 1, 2, 3] if k <> free[(h % 3 + 1)::int]] kept from f)
    select id, array_to_string(kept, ',') as kept, {sql_spread('[p[k + 1] / (p[kept[1] + 1] + p[kept[2] + 1] + p[kept[3] + 1]) for k in kept]', 3)} from d""",
)
def three_option_layout(spark, sf_dir):
    four = F.array(*[F.lit(k) for k in range(4)])
    rows = views(spark, sf_dir).where("view = 0")
    kept = A.drop_option(four, F.array("gold"), K.hash_int(K.order_key("drop", F.col("id"))))
    rows = rows.withColumn("order_kept", kept)
    return rows.select("id", F.array_join("order_kept", ",").alias("kept"), *spread(A.reindexed(F.col("p"), F.col("order_kept")), 3))


@query(
    "five_option_layout",
    f"""with {VIEWS_SQL} select id, {sql_spread('[x / (1 + 1e-8) for x in list_append(p, 1e-8)]', 5)} from views where view = 0""",
)
def five_option_layout(spark, sf_dir):
    kept = F.array(*[F.lit(k) for k in range(4)], F.lit(None).cast("int"))
    return views(spark, sf_dir).where("view = 0").select("id", *spread(A.reindexed(F.col("p"), kept), 5))


@query(
    "pinned_orders",
    f"""with {VALID_SQL}, r as (select id, gold, ({sql_int("sha256('slot:' || id)")} % 4)::int slot,
      list_transform(list_sort([{{'h': sha256(id || ':' || k), 'k': k}} for k in [0, 1, 2, 3] if k <> gold]), lambda s: s.k) rest from valid)
    select id, array_to_string(list_concat(list_concat(rest[1:slot], [gold]), rest[slot + 1:]), ',') as ordering from r""",
)
def pinned_orders(spark, sf_dir):
    slot = K.hash_bucket(K.order_key("slot", F.col("id")), 4)
    return valid_items(spark, sf_dir).select("id", F.array_join(A.pinned_order(F.lit(4), F.col("gold"), slot, F.col("id")), ",").alias("ordering"))


@query(
    "distractor_choice",
    f"""with {VALID_SQL}, a as (select id, options[gold + 1] ans, unnest(options) o from valid),
    b as (select id, o, {sql_keep('o')} n, {sql_keep('ans')} na from a), c as (select id, n, min(o) o, sha256(id || ':' || n) h from b where n <> na and n <> '' group by id, n),
    r as (select id, o, row_number() over (partition by id order by h) k, count(*) over (partition by id) c from c)
    select id, k::int as place, o as distractor from r where k <= 2 and c >= 2""",
)
def distractor_choice(spark, sf_dir):
    answer = F.element_at("options", F.col("gold") + 1)
    chosen = A.distractors(F.col("options"), answer, F.col("id"), 2)
    rows = valid_items(spark, sf_dir).select("id", F.posexplode(chosen).alias("k", "distractor"))
    return rows.select("id", (F.col("k") + 1).alias("place"), "distractor")


@query(
    "divergences",
    f"""with {VIEWS_SQL}, w as (select a.id, a.p p, b.p q from views a join views b using (id) where a.view = 0 and b.view = 1),
    m as (select *, [(p[i] + q[i]) / 2 for i in [1, 2, 3, 4]] m from w)
    select id, round(list_sum([p[i] * (ln(p[i]) - ln(q[i])) for i in [1, 2, 3, 4]]), 8) as kl,
      round((list_sum([p[i] * (ln(p[i]) - ln(m[i])) for i in [1, 2, 3, 4]]) + list_sum([q[i] * (ln(q[i]) - ln(m[i])) for i in [1, 2, 3, 4]])) / 2, 8) as js from m""",
)
def divergences(spark, sf_dir):
    v = views(spark, sf_dir)
    both = v.where("view = 0").select("id", "p").join(v.where("view = 1").select("id", F.col("p").alias("q")), "id")
    return both.select("id", F.round(A.kl(F.col("p"), F.col("q")), 8).alias("kl"), F.round(A.js(F.col("p"), F.col("q")), 8).alias("js"))


@query(
    "temperature_softmax",
    f"""with {VIEWS_SQL}, e as (select id, view, [exp((ln(x) - ln(list_max(p))) / 2.0) for x in p] e from views)
    select id, view, {sql_spread('[x / list_sum(e) for x in e]', 4, 7)} from e""",
)
def temperature_softmax(spark, sf_dir):
    logits = F.transform("p", lambda x: F.log(x))
    return views(spark, sf_dir).select("id", "view", *spread(A.softmax(logits, 2.0), 4, 7))


@query(
    "combined_objective",
    f"""with {VIEWS_SQL}, w as (select a.id, a.gold, a.p p, b.p q from views a join views b using (id) where a.view = 0 and b.view = 1)
    select id, round(0.4 * -ln(p[gold + 1]) + 0.6 * list_sum([q[i] * (ln(q[i]) - ln(p[i])) for i in [1, 2, 3, 4]]), 8) as loss from w""",
)
def combined_objective(spark, sf_dir):
    """Weighted sum of cross entropy on the gold option and divergence from another view."""
    v = views(spark, sf_dir)
    both = v.where("view = 0").select("id", "gold", "p").join(v.where("view = 1").select("id", F.col("p").alias("q")), "id")
    ce = -F.log(F.greatest(F.element_at("p", F.col("gold") + 1), F.lit(A.TINY)))
    return both.select("id", F.round(0.4 * ce + 0.6 * A.kl(F.col("q"), F.col("p")), 8).alias("loss"))


@query(
    "learning_rates",
    """with s as (select range::int as step, range / 1000.0::double p from range(0, 1001))
    select step, round(case when p < 0.05 then 0.00015 * greatest(0.01, p / 0.05) else 0.000015 + 0.000135 * 0.5 * (1 + cos(pi() * (p - 0.05) / 0.95)) end, 12) as rate,
      case when step <= 100 then 0.0::double when step >= 140 then 0.5::double else 0.5 * (step - 100) / 40.0::double end as consistency from s""",
)
def learning_rates(spark, sf_dir):
    steps = spark.range(1001).select(F.col("id").cast("int").alias("step"))
    rate = A.learning_rate(F.col("step") / 1000.0, 0.00015, 0.000015)
    return steps.select("step", F.round(rate, 12).alias("rate"), A.ramp(F.col("step"), 100, 140, 0.5).alias("consistency"))


@query(
    "feature_maps",
    """with d as (select doc_id, 'Lang=' || coalesce(lang, 'xx') || '|Number=Sing|Size=' || coalesce(n_chars, 0) feats from documents)
    select doc_id, regexp_extract(feats, 'Lang=([^|]*)', 1) as lang_feature, 'noun, sing' as analysis, 2::bigint as mutations from d""",
)
def feature_maps(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    feats = F.concat(F.lit("Lang="), F.coalesce("lang", F.lit("xx")), F.lit("|Number=Sing|Size="), F.coalesce(F.col("n_chars").cast("string"), F.lit("0")))
    rows = d.select("doc_id", A.parse_features(feats).alias("f"))
    changed = A.mutate_features(F.col("f"), {"Number": ("Sing", "Plur"), "Size": ("-1",), "Case": ("Nom", "Acc")})
    return rows.select("doc_id", F.element_at("f", "Lang").alias("lang_feature"), A.format_features(F.lit("NOUN"), F.col("f")).alias("analysis"),
                       F.size(changed).cast("bigint").alias("mutations"))


@query(
    "relation_words",
    """select id, array_to_string(w, ' | ') as words from (select id, list_sort(list_distinct(list_concat(options, [gold_text]))) w
    from (select distinct id, options, gold_text from zagreus_exam_bank_v1 where options is not null and gold_text is not null and not list_contains([o is null for o in options], true)))""",
)
def relation_words(spark, sf_dir):
    """Distinct words over a row and its nested lists."""
    rows = read_table(spark, sf_dir, "zagreus_exam_bank_v1").select("id", "options", "gold_text").distinct()
    rows = rows.where(F.col("options").isNotNull() & F.col("gold_text").isNotNull() & ~F.exists("options", lambda o: o.isNull()))
    return rows.select("id", F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array("options", F.array("gold_text"))))), " | ").alias("words"))


@query(
    "bounded_pools",
    """with w as (select distinct domain as word from zagreus_exam_bank_v1 where domain is not null), n as (select word, row_number() over (order by word) - 1 pos, count(*) over () n from w),
    s as (select item_id, (('0x' || substr(sha256('pool:' || item_id), 1, 8))::BIGINT) h from benchmark),
    p as (select item_id, k, word, row_number() over (partition by item_id, word order by k) f from s, range(0, 40) t(k), n where pos = (h + k * 7919) % n.n),
    r as (select item_id, word, row_number() over (partition by item_id order by k) place from p where f = 1)
    select item_id, word, place::int as place from r where place <= 6""",
)
def bounded_pools(spark, sf_dir):
    """Six distinct words per item, by a hashed start and a fixed stride through the numbered word list."""
    from pyspark.sql import Window

    words = read_table(spark, sf_dir, "zagreus_exam_bank_v1").where("domain is not null").select(F.col("domain").alias("word")).distinct()
    numbered = words.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("word")) - 1)  # a vocabulary of categories
    n = numbered.count()
    if n == 0:
        return spark.createDataFrame([], "item_id bigint, word string, place int")
    start = read_table(spark, sf_dir, "benchmark").select("item_id", K.hash_int(K.order_key("pool", F.col("item_id"))).alias("h"))
    probes = start.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"), "h").withColumn("at", ((F.col("h") + F.col("k") * 7919) % n).cast("int"))
    found = probes.join(F.broadcast(numbered), "at").groupBy("item_id", "word").agg(F.min("k").alias("k"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("k"))
    return found.select("item_id", "word", place.alias("place")).where("place <= 6")


