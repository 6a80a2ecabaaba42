"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions import keys as K
from siftwright.functions import text as X
from siftwright.operators.filters import denied
from siftwright.plans.base import ITEMS_SQL, VALID_SQL, items, sql_fold, sql_int, sql_keep, valid_items
from siftwright.plans.registry import query
from siftwright.session import read_table

STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({sql_fold(x)}, ' '), lambda w: length(w) > 1 and not list_contains({STOP}, w))"


@query("normal_forms", f"select doc_id, sha256({sql_fold('text')}) as fold_hash, sha256({sql_keep('text')}) as keep_hash from documents")
def normal_forms(spark, sf_dir):
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.norm_fold(t), 256).alias("fold_hash"), F.sha2(X.norm_keep(t), 256).alias("keep_hash"))


@query("compact_text", "select doc_id, trim(regexp_replace(replace(text, chr(12), ''), '\\s+', ' ', 'g')) as compacted from documents")
def compact_text(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.compact(F.col("text")).alias("compacted"))


@query(
    "word_shingle_counts",
    f"""with {ITEMS_SQL}, w as (select id, {sql_words('question')} words from items)
    select id, len(words)::bigint as words, len(list_distinct(case when len(words) >= 3
      then [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] else words end))::bigint as shingles from w""",
)
def word_shingle_counts(spark, sf_dir):
    words = items(spark, sf_dir).select("id", X.content_words(X.norm_fold(F.col("question"))).alias("w"))
    return words.select("id", F.size("w").cast("bigint").alias("words"), F.size(X.word_shingles(F.col("w"))).cast("bigint").alias("shingles"))


def _domain_sql() -> str:
    key = lambda x: f"replace({sql_fold(x)}, ' ', '_')"
    arms = "".join(
        f" when {' or '.join(f'''contains(v, '{f}')''' for f in fragments)} then '{domain}'" for domain, fragments in X.DOMAIN_FRAGMENTS
    )
    return (
        f"select id, case when contains(v, 'attual') then null{arms} end as mapped from "
        f"(select distinct id, {key('question')} || ' ' || {key('source')} as v from zagreus_final_instrument)"
    )


@query("domain_rules", _domain_sql())
def domain_rules(spark, sf_dir):
    rows = read_table(spark, sf_dir, "zagreus_final_instrument").select("id", "question", "source").distinct()
    return rows.select("id", X.map_domain(F.col("question"), F.col("source")).alias("mapped"))


CODES = {"H": "history", "L": "lexicon", "M": "morphology", "O": "orthography", "S": "syntax", "T": "geography", "E": "civic_education"}


@query(
    "code_domains",
    "select id, case upper(substr(record_code, 1, 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in CODES.items())
    + " end as coded from (select distinct id, record_code from zagreus_exam_bank_v1)",
)
def code_domains(spark, sf_dir):
    rows = read_table(spark, sf_dir, "zagreus_exam_bank_v1").select("id", "record_code").distinct()
    return rows.select("id", X.code_domain(F.substring("record_code", 1, 1), CODES).alias("coded"))


def _cues(cues) -> str:
    return "(" + " or ".join(f"contains(t, '{c}')" for c in cues) + ")"


@query(
    "history_predicates",
    f"""with {ITEMS_SQL}, n as (select id, {sql_fold("question || ' ' || coalesce(array_to_string(options, ' '), '')")} t from items),
    y as (select id, t, [x::int for x in regexp_extract_all(t, '(\\d+)', 1) if regexp_full_match(x, '1[0-9]{{3}}|20[0-9]{{2}}')] ys from n),
    f as (select id, len([x for x in ys if x > 2000]) > 0 or {_cues(X.CURRENT_CUES)} as is_current,
      len([x for x in ys if x between 1000 and 2000]) > 0 or {_cues(X.HISTORY_CUES)} as historic from y)
    select id, is_current, not is_current and historic as is_stable from f""",
)
def history_predicates(spark, sf_dir):
    text = F.concat(F.col("question"), F.lit(" "), F.coalesce(F.array_join("options", " "), F.lit("")))
    rows = items(spark, sf_dir).select("id", X.norm_fold(text).alias("t"))
    return rows.select("id", X.is_current(F.col("t")).alias("is_current"), X.is_stable_history(F.col("t")).alias("is_stable"))


@query(
    "clean_words_and_glosses",
    f"""with {ITEMS_SQL}, o as (select id, question, unnest(options) o from items),
    p as (select id, question, o, regexp_replace(regexp_replace(coalesce(o, ''), '\\s+', ' ', 'g'), '^[ .;:]+|[ .;:]+$', '', 'g') g, regexp_extract(question, '«([^»]*)»', 1) w from o),
    q as (select *, {sql_keep('g')} low, {sql_keep('w')} wk from p)
    select id, o as option, case when regexp_full_match(trim(coalesce(o, ''), ' '), '[A-Za-zÀ-ÖØ-öø-ÿ]+') and length(trim(o, ' ')) between 3 and 22 then trim(o, ' ') end as word,
      case when length(g) between 18 and 220 and not (starts_with(low, 'plurale di ') or starts_with(low, 'femminile di ') or starts_with(low, 'maschile di ')
        or starts_with(low, 'forma di ')) and wk <> low and wk <> string_split(low, ' (')[1] then g end as gloss from q""",
)
def clean_words_and_glosses(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "question", F.explode("options").alias("option"))
    word = F.regexp_extract("question", "«([^»]*)»", 1)
    return rows.select("id", "option", X.clean_word(F.col("option")).alias("word"), X.clean_gloss(F.col("option"), word).alias("gloss"))


@query("spelling_variants")
def spelling_variants(spark, sf_dir):
    """Misspellings of the right forms of orthography items that are not themselves words of the table."""
    rows = valid_items(spark, sf_dir).where("domain = 'orthography'")
    words = rows.select(F.lower(F.element_at("options", F.col("gold") + 1)).alias("word")).distinct()
    made = words.select("word", F.explode(X.spelling_variants(F.col("word"))).alias("variant"))
    return made.join(words.select(F.col("word").alias("variant")), "variant", "left_anti").select("word", "variant")


@query("html_unescaped")
def html_unescaped(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").where("text like '%&%'")
    return rows.select("doc_id", X.html_unescape(F.col("text")).alias("text"))


@query("full_normal_forms")
def full_normal_forms(spark, sf_dir):
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select("doc_id", X.norm_fold_full(t).alias("fold"), X.norm_keep_full(t).alias("keep"))


TEMPLATES = ("Che cosa significa {x}?", "Spiega {x}.", "Indica il senso di {x}.")


@query(
    "template_choice",
    f"""with {ITEMS_SQL} select id, replace(['{"', '".join(TEMPLATES)}'][({sql_int("sha256('template:' || id)")} % 3 + 1)::int], '{{x}}', coalesce(domain, '?')) as rendered from items""",
)
def template_choice(spark, sf_dir):
    chosen = X.pick_template(TEMPLATES, K.hash_int(K.order_key("template", F.col("id"))))
    return items(spark, sf_dir).select("id", F.replace(chosen, F.lit("{x}"), F.coalesce("domain", F.lit("?"))).alias("rendered"))


@query("masked_answers")
def masked_answers(spark, sf_dir):
    """Items whose question holds exactly one whole word equal to the first word of its quotation."""
    word = F.regexp_extract("question", r"«(\w+)", 1)
    rows = valid_items(spark, sf_dir).select("id", X.mask_once(F.col("question"), word).alias("masked"))
    return rows.where("masked is not null")


@query(
    "rendered_questions",
    f"""with {VALID_SQL} select id, case when trim(coalesce(context, ''), ' ') <> '' then trim(context, ' ') || chr(10) || chr(10) || question else question end
      || chr(10) || 'A. ' || options[1] || chr(10) || 'B. ' || options[2] || chr(10) || 'C. ' || options[3] || chr(10) || 'D. ' || options[4] as prompt from valid""",
)
def rendered_questions(spark, sf_dir):
    order = F.array(*[F.lit(i) for i in range(4)])
    text = F.concat(X.question_text(F.col("context"), F.col("question")), F.lit("\n"), X.display_lines(F.col("options"), order))
    return valid_items(spark, sf_dir).select("id", text.alias("prompt"))


@query(
    "semantic_surfaces",
    f"""with {VALID_SQL} select id, question as plain, question || chr(10) || chr(10) || array_to_string(list_sort([trim(o, ' ') for o in options]), ' || ') as with_options from valid""",
)
def semantic_surfaces(spark, sf_dir):
    plain, full = X.semantic_surfaces(F.col("question"), F.col("options"))
    return valid_items(spark, sf_dir).select("id", plain.alias("plain"), full.alias("with_options"))


@query(
    "question_surfaces",
    f"""with {ITEMS_SQL}, s as (select id, unnest([question, context, domain || ': ' || question]) surface from items)
    select id, surface from s where surface is not null and trim(surface, ' ') <> ''""",
)
def question_surfaces(spark, sf_dir):
    """Questions of a row from its own columns and from user messages."""
    said = F.array(
        F.struct(F.lit("system").alias("role"), F.lit("x").alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat("domain", F.lit(": "), "question").alias("content")),
    )
    return items(spark, sf_dir).select("id", F.explode(X.question_surfaces(F.col("question"), F.col("context"), messages=said)).alias("surface"))


@query("option_values", f"with {ITEMS_SQL}, o as (select id, unnest(options) o from items) select id, o as value from o where o is not null and not starts_with(o, '{{')")
def option_values(spark, sf_dir):
    """Option texts read back from the three forms in which sources write them."""
    rows = items(spark, sf_dir).select("id", F.posexplode("options").alias("k", "o")).where("o is not null and not startswith(o, '{')")
    form = F.when(F.col("k") % 3 == 0, F.col("o")).when(F.col("k") % 3 == 1, F.to_json(F.struct(F.col("o").alias("value")))).otherwise(F.to_json(F.create_map(F.lit("B"), F.col("o"))))
    return rows.select("id", X.option_value(form).alias("value"))


@query(
    "parsed_answers",
    """with d as (select doc_id, text as o from documents), p as (select doc_id, o, nullif(regexp_extract(coalesce(o, ''), '([A-Z])', 1), '') l from d)
    select doc_id, l as parsed, coalesce(regexp_full_match(l, '[A-D]'), false) as valid, coalesce(regexp_full_match(trim(o, ' '), '[A-D]'), false) as exact from p""",
)
def parsed_answers(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in X.parse_answer(F.col("text")).items()])


@query(
    "footer_artifacts",
    "select id, len([o for o in options if regexp_matches(trim(o), '(?i)\\bpagina(\\s+\\d+)?\\s*$')]) > 0 as footer from (select distinct id, options from zagreus_exam_bank_v1) where options is not null",
)
def footer_artifacts(spark, sf_dir):
    rows = read_table(spark, sf_dir, "zagreus_exam_bank_v1").where("options is not null").select("id", "options").distinct()
    return rows.select("id", F.coalesce(X.footer_artifact(F.col("options")), F.lit(False)).alias("footer"))


@query(
    "denied_sources",
    "select id, lower(coalesce(source, '')) = 'banca_quesiti_mirto' or starts_with(lower(id), 'zfi:history:') as denied from (select distinct id, source from zagreus_final_instrument)",
)
def denied_sources(spark, sf_dir):
    rows = read_table(spark, sf_dir, "zagreus_final_instrument").select("id", "source").distinct()
    return rows.select("id", (denied([F.col("source")], ["banca_quesiti_mirto"], []) | denied([F.col("id")], [], ["zfi:history:"])).alias("denied"))


@query("style_matches")
def style_matches(spark, sf_dir):
    """Held-out questions whose wording is close to one of three fixed exemplars."""
    known = ["Quale forma è scritta bene?", "Qual è il contrario di «alto»?", "Quale definizione corrisponde alla voce «casa»?"]
    return read_table(spark, sf_dir, "benchmark").select("item_id", X.similar_style(F.col("question"), known).alias("close"))
