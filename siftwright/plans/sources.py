"""Queries of readers, writers and streams: tables are written in a source format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.plans.base import VALID_SQL, valid_items
from siftwright.plans.registry import query
from siftwright.session import Scratch, read_table
from siftwright.sources import conllu, files, records
from siftwright.streaming import views as stream_views

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _folder(spark, name: str) -> str:
    return f"{Scratch(spark, name).root}/files"


@query("jsonl_round_trip", "select doc_id, lang, source, coalesce(length(text), -1)::bigint as chars from documents")
def jsonl_round_trip(spark, sf_dir):
    path = _folder(spark, "jsonl")
    files.write_jsonl(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    rows = files.project(files.read_jsonl(spark, path, DOCUMENT), ["doc_id", "lang", "source", "text"])
    return rows.select("doc_id", "lang", "source", F.coalesce(F.length("text"), F.lit(-1)).cast("bigint").alias("chars"))


@query("jsonl_filtered", "select doc_id, source from documents where lang = 'it'")
def jsonl_filtered(spark, sf_dir):
    path = _folder(spark, "gz")
    read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source").write.option("compression", "gzip").json(path)
    return files.read_filtered_jsonl(spark, path, "doc_id bigint, lang string, source string", "lang", "it").select("doc_id", "source")


@query("append_resume", "select count(*)::bigint as rows, count(distinct doc_id)::bigint as ids from documents")
def append_resume(spark, sf_dir):
    """Appending twice, once in part, leaves each row once."""
    path, schema = _folder(spark, "append"), "doc_id bigint, lang string"
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    for part in (rows.where("doc_id % 2 = 0"), rows, rows):
        files.append_pending(part, path, schema, "doc_id")
    return files.read_jsonl(spark, path, schema).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids"))


@query(
    "conllu_tokens",
    """with t as (select doc_id, [w for w in regexp_split_to_array(text, '\\s+') if w <> ''] w from documents where text is not null)
    select doc_id::varchar as sent_id, len(w)::bigint as tokens, (len(w) - 1)::bigint as last_head, w[1] as first_form from t where len(w) > 0""",
)
def conllu_tokens(spark, sf_dir):
    """Documents written as treebank blocks, a token per line, and read back."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    line = F.transform("w", lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, F.lower(w), F.lit("NOUN"), F.lit("_"), F.lit("Number=Sing"),
                                                      i.cast("string"), F.lit("nsubj:pass"), F.lit("_"), F.lit("_")))
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", words.alias("w")).where("size(w) > 0")
    block = F.concat(F.lit("# sent_id = "), F.col("doc_id").cast("string"), F.lit("\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n"), F.array_join(line, "\n"), F.lit("\n"))
    path = _folder(spark, "conllu")
    rows.select(block.alias("value")).write.text(path)
    parsed = conllu.read_conllu(spark, path)
    return parsed.select("sent_id", F.size("tokens").cast("bigint").alias("tokens"), F.element_at("tokens", -1)["head"].cast("bigint").alias("last_head"),
                         F.element_at("tokens", 1)["form"].alias("first_form"))


@query("parsed_benchmark_options", f"with {VALID_SQL} select id, options[1] as first_option, gold from valid")
def parsed_benchmark_options(spark, sf_dir):
    """Options as a list of one-key maps and an answer label, parsed back."""
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    maps = F.to_json(F.transform("options", lambda o, i: F.create_map(F.element_at(letters, i + 1), o)))
    rows = valid_items(spark, sf_dir).select("id", maps.alias("options"), F.element_at(letters, F.col("gold") + 1).alias("answer"))
    return rows.select("id", *files.parse_benchmark_options()).select("id", F.element_at("options", 1).alias("first_option"), "gold")


@query("printed_records")
def printed_records(spark, sf_dir):
    """Bank records printed in fixed columns and parsed back, one row per code found."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s\p{Z}]+", " "), r"\b[a-d]\)", ""))
    column = lambda c, n: F.rpad(c, F.greatest(F.lit(n), F.length(c) + 2), F.lit(" "))  # noqa: E731  rpad cuts what is longer
    rows = read_table(spark, sf_dir, "zagreus_exam_bank_v1").where("size(options) = 4 and gold between 0 and 3 and question is not null and record_code is not null").select("id", "record_code", "question", "options", "gold").distinct()
    cells = [column(F.concat(F.lit(f"{x}) "), clean(F.element_at("options", k + 1))), 130) for k, x in enumerate("abcd")]
    line = F.concat("record_code", F.lit("  "), column(clean(F.col("question")), 420), *cells, F.lit("   "), F.element_at(F.array(*[F.lit(x) for x in "abcd"]), F.col("gold") + 1))
    return records.parse_tables(rows.select(F.col("id").alias("member"), line.alias("text"))).select("member", "record_code", "question", "gold", "gold_letter", "reason")


@query("protected_rows", "select item_id, question_hash from benchmark")
def protected_rows(spark, sf_dir):
    return files.load_protected(spark, f"{sf_dir}/benchmark.parquet").select("item_id", "question_hash")


def _replayed(spark, rows, name: str):
    path = _folder(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _run(spark, stream, name: str):
    out = _folder(spark, name + "-out")
    stream.writeStream.format("parquet").option("checkpointLocation", _folder(spark, name + "-log")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_labelled_once", "select count(*)::bigint as rows, count(distinct event_id)::bigint as ids from events")
def stream_labelled_once(spark, sf_dir):
    """A stream in which every event is delivered twice, labelled once each."""
    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    done = _run(spark, stream_views.once(_replayed(spark, rows.union(rows), "twice"), ["event_id"], "ts", "3650 days"), "once")
    return done.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("ids"))


@query(
    "stream_windowed_counts",
    "select time_bucket(interval '1 hour', ts)::timestamp as start, event_type, count(*) as n from events where ts is not null group by 1, 2",
)
def stream_windowed_counts(spark, sf_dir):
    """Hourly counts per type from a stream of events, late ones within the watermark included."""
    rows = read_table(spark, sf_dir, "events").where("ts is not null").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    counts = stream_views.windowed_counts(_replayed(spark, rows, "hours"), "ts", "1 hour", "3650 days", "event_type")
    kept = stream_views.keep_updates(counts, ["start", "event_type"], _folder(spark, "hours-out"), _folder(spark, "hours-log"))
    return kept.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_complete_views")
def stream_complete_views(spark, sf_dir):
    """Items whose four views have arrived in the stream, each emitted once."""
    from siftwright.plans.base import predictions

    rows = predictions(spark, sf_dir).select("id", "view", F.col("prediction").alias("top1"))
    stream = _replayed(spark, rows.union(rows.where("view < 2")), "views")
    return _run(spark, stream_views.complete_views(stream), "complete").select("id", "views", F.array_join("top1", ",").alias("top1"))
