"""Queries of stage contracts: pins, manifests, gates, allow-lists, exclusions, transcripts and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions import keys as K
from siftwright.functions import text as X
from siftwright.operators import gates as V
from siftwright.operators import joins
from siftwright.plans.base import VALID_SQL, sql_fold, valid_items
from siftwright.plans.registry import query
from siftwright.session import Scratch, read_table, shared_dir
from siftwright.sources import files

SYSTEM = "Sei un assistente utile."
PREFIXES, LICENCES = ("banca_", "raccolta_", "synthetic_"), ("CC0-1.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0")
DENIED = ("_lex_", "_civ_", ".tmp")


def _lines(order: str) -> str:
    shown = " || chr(10) || ".join(f"'{x}. ' || options[{int(k) + 1}]" for x, k in zip("ABCD", order))
    return f"({shown})"


@query(
    "chat_transcripts",
    f"""with {VALID_SQL}, q as (select id, gold, case when trim(coalesce(context, ''), ' ') <> '' then trim(context, ' ') || chr(10) || chr(10) || question else question end q, options from valid),
    m as (select id, '{SYSTEM}' || chr(10) || q || chr(10) || {_lines('0123')} as a, ['A', 'B', 'C', 'D'][gold + 1] l, q || chr(10) || {_lines('3210')} as b from q)
    select id, a || chr(10) || l || chr(10) || b as transcript, (length(a) + 1)::int as begin, (length(a) + 2)::int as "end", l as said from m""",
)
def chat_transcripts(spark, sf_dir):
    """A demonstration with its answer and the same item shown in another order, with the place of the answer."""
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    order = lambda *k: F.array(*[F.lit(x) for x in k])
    rows = valid_items(spark, sf_dir).select("id", X.question_text(F.col("context"), F.col("question")).alias("q"), "options", "gold")
    shown = lambda *k: F.concat("q", F.lit("\n"), X.display_lines(F.col("options"), order(*k)))
    turns = F.array(
        X.message("system", F.lit(SYSTEM)), X.message("user", shown(0, 1, 2, 3)),
        X.message("assistant", F.element_at(letters, F.col("gold") + 1)), X.message("user", shown(3, 2, 1, 0)),
    )
    rows = rows.select("id", turns.alias("m")).select("id", X.transcript(F.col("m")).alias("transcript"), F.explode(X.turn_spans(F.col("m"))).alias("s"))
    said = F.substring("transcript", F.col("s.begin") + 1, F.col("s.end") - F.col("s.begin"))
    return rows.select("id", "transcript", "s.begin", "s.end", said.alias("said"))


@query(
    "source_allow_list",
    f"""with l as (select distinct id, source, license from zagreus_final_instrument),
    f as (select coalesce({' or '.join(f"starts_with(source, '{p}')" for p in PREFIXES)}, false) s, coalesce(license in {LICENCES}, false) l from l)
    select s as source_ok, l as licence_ok, count(*) as rows from f group by all""",
)
def source_allow_list(spark, sf_dir):
    """Items by whether their source and their licence are allowed."""
    rows = read_table(spark, sf_dir, "zagreus_final_instrument").select("id", "source", "license").distinct()
    return V.allowed_sources(rows, "source", PREFIXES, "license", LICENCES).groupBy("source_ok", "licence_ok").agg(F.count(F.lit(1)).alias("rows"))


def _pin_sql(name: str, key: str, *columns: str) -> str:
    text = " || chr(31) || ".join(f"coalesce({c}::varchar, '')" for c in (key, *columns))
    return f"""select '{name}' as name, (select count(*) from {name}) as rows, (select count(distinct {key}) from {name}) as keys,
      (select sha256(array_to_string(list_sort(list(b || part)), chr(10))) from (select substr(h, 1, 3) b, sha256(array_to_string(list_sort(list(h)), chr(10))) part
        from (select sha256({text}) h from {name}) group by 1)) as content_hash"""


_PINNED = {"benchmark": ("item_id", "domain", "question_hash"), "token_budgets": ("budget_id", "budget_name", "capacity_tokens")}


@query("pinned_tables", " union all ".join(_pin_sql(n, *c) for n, c in _PINNED.items()))
def pinned_tables(spark, sf_dir):
    """Row count and content hash of the fixed tables, as a stage pins them."""
    out = None
    for name, columns in _PINNED.items():
        one = V.content_pin(read_table(spark, sf_dir, name), *columns).select(F.lit(name).alias("name"), "rows", "keys", "content_hash")
        out = one if out is None else out.unionByName(one)
    return out


_COUNTS = {"items": "zagreus_final_instrument", "protected": "benchmark"}


def _manifest(spark, sf_dir) -> str:
    counts = None
    for name, table in _COUNTS.items():
        one = read_table(spark, sf_dir, table).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n")
        counts = one if counts is None else counts.unionByName(one)
    pin = V.content_pin(read_table(spark, sf_dir, "benchmark"), *_PINNED["benchmark"]).first()["content_hash"]
    return V.manifest("screened", counts, {"containment": 0.8, "jaccard": 0.7}, {"benchmark": pin})


@query(
    "stage_manifest",
    f"""with p as ({_pin_sql('benchmark', *_PINNED['benchmark'])}) select '{{"counts": {{"items": ' || (select count(*) from zagreus_final_instrument) || ', "protected": ' || p.rows ||
    '}}, "lineage": {{"benchmark": "' || content_hash || '"}}, "status": "screened", "thresholds": {{"containment": 0.8, "jaccard": 0.7}}}}' as manifest from p""",
)
def stage_manifest(spark, sf_dir):
    """What a stage leaves for the next: status, counts, thresholds and hashes of its inputs."""
    return spark.createDataFrame([(_manifest(spark, sf_dir),)], "manifest string")


@query("stage_gates", "select * from (values ('screen', 'screened', true), ('adjudicate', 'screened', true), ('release', 'adjudicated', false)) t(stage, needs, allowed)")
def stage_gates(spark, sf_dir):
    """Which stages may start on the manifest of the screening stage."""
    text, rows = _manifest(spark, sf_dir), []
    for stage, needs in (("screen", "screened"), ("adjudicate", "screened"), ("release", "adjudicated")):
        try:
            V.require_status(text, needs)
            rows.append((stage, needs, True))
        except ValueError:
            rows.append((stage, needs, False))
    return spark.createDataFrame(rows, "stage string, needs string, allowed boolean")


_REPLAY_SQL = f"""e as (select group_id g, sha256({sql_fold('question')}) h from zagreus_exam_bank_v1),
r as (select id, group_id g, sha256({sql_fold('question')}) h from (select distinct id, group_id, question from zagreus_scaled_kd_data)),
x as (select id, case when g in (select g from e where g is not null) then 'group' when h in (select h from e where h is not null) then 'question' else 'kept' end as reason from r)"""


@query("replay_exclusion", f"with {_REPLAY_SQL} select reason, count(*) as rows from x group by reason")
def replay_exclusion(spark, sf_dir):
    """Replay rows excluded by a group or, failing that, by a question that the exam bank has."""
    rows = read_table(spark, sf_dir, "zagreus_scaled_kd_data").select("id", "group_id", "question").distinct()
    rows = rows.select("id", "group_id", K.question_hash(F.col("question")).alias("h"))
    exam = read_table(spark, sf_dir, "zagreus_exam_bank_v1").select("group_id", K.question_hash(F.col("question")).alias("h"))
    return joins.first_exclusion(rows, exam, {"group": "group_id", "question": "h"}).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("denied_members", f"select id, {' || '.join(f"case when contains(lower(source_member), '{t}') then '{t};' else '' end" for t in DENIED)} as terms from (select distinct id, source_member from zagreus_exam_bank_v1) where {' or '.join(f"contains(lower(source_member), '{t}')" for t in DENIED)}")
def denied_members(spark, sf_dir):
    """Bank records from archive members whose path holds a denied term."""
    rows = read_table(spark, sf_dir, "zagreus_exam_bank_v1").select("id", "source_member").distinct()
    rows = rows.select("id", X.denied_path(F.col("source_member"), DENIED).alias("t")).where(F.size("t") > 0)
    return rows.select("id", F.array_join(F.transform("t", lambda t: F.concat(t, F.lit(";"))), "").alias("terms"))


@query("private_key_paths", "select distinct id, 'gold;metadata.answer' as paths from zagreus_final_instrument where metadata.answer is not null and gold is not null")
def private_key_paths(spark, sf_dir):
    """Rows whose JSON form holds both private keys, with their paths."""
    rows = read_table(spark, sf_dir, "zagreus_final_instrument").select("id", F.to_json(F.struct("id", "gold", "options", "metadata")).alias("j"))
    found = rows.select("id", F.array_join(V.private_keys(F.col("j"), ("gold", "answer")), ";").alias("paths"))
    return found.where("paths = 'gold;metadata.answer'").distinct()


@query("score_matrix_round_trip", "select vec_id, len(embedding)::int as width, round(embedding[1]::double, 6) as first from embeddings")
def score_matrix_round_trip(spark, sf_dir):
    """A matrix of scores written and read back."""
    path = f"{Scratch(spark, 'matrix').root}/m"
    files.write_matrix(read_table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding")
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("width"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query("discovered_files", "select * from (values ('a.jsonl', 1), ('b.jsonl', 2)) t(name, depth)")
def discovered_files(spark, sf_dir):
    """Files found in a tree, but for other kinds and an excluded folder."""
    root = f"{shared_dir(spark).rstrip('/')}/tree-{Scratch(spark, 't').root[-12:]}"
    one = spark.range(1).select(F.lit("{}").alias("value"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    for name in ("a.jsonl", "sub/b.jsonl", "old/c.jsonl", "sub/d.txt"):
        part = f"{root}/parts/{name.replace('/', '-')}"
        one.coalesce(1).write.text(part)
        made, goal = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(f"{root}/tree/{name}")
        fs = made.getFileSystem(conf)
        fs.mkdirs(goal.getParent())
        file = next(f.getPath() for f in fs.listStatus(made) if f.getPath().getName().startswith("part-"))
        fs.rename(file, goal)
    found = files.discover(spark, f"{root}/tree", r"\.jsonl$", ["old"])
    inside = F.regexp_extract("path", r"/tree/(.*)$", 1)
    return found.select(F.element_at(F.split(inside, "/"), -1).alias("name"), F.size(F.split(inside, "/")).alias("depth"))
