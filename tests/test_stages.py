import pytest
from pyspark.sql import functions as F

from siftwright.functions import text as X
from siftwright.operators import gates, joins, ranking
from siftwright.plans import screens
from siftwright.session import shared_dir
from siftwright.streaming import views


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_recheck_finds_a_planted_leak(spark):
    passage = "notaio bosco fiume ponte torre mercato quaderno lettera sigillo archivio bottega confine"
    refs = spark.createDataFrame([(1, passage), (2, None)], "ref_id bigint, text string")
    clean = [(1, "mare monte isola grano orto lago duna erba riva sale uva zolla"), (2, None), (3, "")]
    assert rows_of(screens.recheck(spark.createDataFrame(clean, "id bigint, text string"), refs)) == [(0, 0.0, 0)]
    kept = [*clean, (4, "Inizio " + passage.upper() + " fine"), (5, passage + "!")]
    assert rows_of(screens.recheck(spark.createDataFrame(kept, "id bigint, text string"), refs)) == [(2, 1.0, 1)]


def test_leaking_keys(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("c", "y")], "g string, split string")
    assert rows_of(joins.leaking_keys(rows, "g")) == [("x", 2, 1), ("y", 2, 1)]
    assert rows_of(joins.leaking_keys(rows.limit(0), "g")) == []


def test_attach_one_keeps_all_rows(spark):
    rows = spark.createDataFrame([("a", "01", 1), ("b", "01", 2), ("c", "01", 3), ("d", "01", 4)], "id string, o string, n int")
    more = spark.createDataFrame([("a", "01", 0.5), ("b", "10", 0.6), ("c", "01", 0.7), ("c", "01", 0.8), ("z", "01", 0.9)], "id string, o string, p double")
    got = joins.attach_one(rows, more, "id", "o", ["p"])
    assert rows_of(got.select("id", "attached_rows", "same_order", F.coalesce("p", F.lit(-1.0)))) == [
        ("a", 1, True, 0.5), ("b", 1, False, 0.6), ("c", 2, False, -1.0), ("d", 0, False, -1.0)
    ]
    assert rows_of(joins.covered(got)) == [(4, 2, 1, False)]
    assert rows_of(joins.covered(got.where("id = 'a'"))) == [(1, 0, 0, True)]


def test_first_exclusion(spark):
    rows = spark.createDataFrame([(1, "g", "q"), (2, "x", "q"), (3, None, None), (4, "x", "y")], "id int, g string, q string")
    out = spark.createDataFrame([("g", "q"), (None, "q"), (None, None), ("g", "q")], "g string, q string")
    assert rows_of(joins.first_exclusion(rows, out, {"group": "g", "question": "q"}).select("id", "reason")) == [
        (1, "group"), (2, "question"), (3, "kept"), (4, "kept")
    ]


def test_transcript_spans(spark):
    m = F.array(X.message("system", F.lit("però")), X.message("assistant", F.lit("A")), X.message("user", F.lit("")), X.message("assistant", F.lit("BC")))
    got = spark.range(1).select(m.alias("m")).select(X.transcript(F.col("m")).alias("t"), X.turn_spans(F.col("m")).alias("s")).first()
    assert [got.t[s.begin : s.end] for s in got.s] == ["A", "BC"] and got.t == "però\nA\n\nBC"


def test_mark_lowest_agrees_with_take_lowest(spark):
    rows = spark.createDataFrame([(f"s{i % 3}", f"k{i}") for i in range(900)], "s string, k string").withColumn("h", F.md5(F.col("k").cast("binary")))
    quotas = spark.createDataFrame([("s0", 17), ("s1", 900)], "s string, quota bigint")
    marked = ranking.mark_lowest(rows, quotas, ["s"], "k", "h")
    assert marked.count() == 900
    assert rows_of(marked.where("taken").select("k")) == rows_of(ranking.take_lowest(rows, quotas, ["s"], "k", "h").select("k"))


def test_allowed_sources_and_paths(spark):
    rows = spark.createDataFrame([("a_1", "CC0"), ("b_1", "CC0"), (None, None), ("a_2", "other")], "source string, licence string")
    got = gates.allowed_sources(rows, "source", ["a_"], "licence", ["CC0"])
    assert rows_of(got.select("source_ok", "licence_ok")) == [(False, False), (False, True), (True, False), (True, True)]
    paths = spark.createDataFrame([("x/Official/a",), ("b",), (None,)], "p string").select(X.denied_path(F.col("p"), ["official", "test"]).alias("t"))
    assert sorted(tuple(r.t) for r in paths.collect()) == [(), (), ("official",)]


def test_private_keys_in_json(spark):
    texts = ['{"a": {"gold": 1, "b": [{"gold": 2}, 3]}, "gold": null}', "{}", "no json", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").select("i", gates.private_keys(F.col("j"), ["gold"]).alias("k"))
    assert {r.i: r.k for r in got.collect()} == {0: ["a.b[].gold", "a.gold", "gold"], 1: [], 2: ["?"], 3: None}


def test_content_pin_does_not_depend_on_layout(spark):
    df = spark.createDataFrame([(i, f"t{i}" if i % 7 else None) for i in range(300)], "i int, t string")
    one, other = gates.content_pin(df.coalesce(1), "i", "t").first(), gates.content_pin(df.repartition(7), "i", "t").first()
    assert one == other and one["rows"] == 300
    gates.require_content(gates.content_pin(df, "i", "t"), 300, one["content_hash"])
    with pytest.raises(ValueError):
        gates.require_content(gates.content_pin(df.where("i > 0"), "i", "t"), 300, one["content_hash"])
    assert gates.content_pin(df.limit(0), "i", "t").first()["rows"] == 0


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_last_state_of_each_key(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "ts timestamp, kind string"
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for batch in (["a", "a", "b"], ["a"]):
        spark.createDataFrame([(k,) for k in batch], "kind string").select(F.lit("2024-01-01 00:10:00").cast("timestamp").alias("ts"), "kind").write.mode("append").parquet(source)
        counts = views.windowed_counts(spark.readStream.schema(schema).parquet(source), "ts", "1 hour", "3650 days", "kind")
        got = views.keep_updates(counts, ["start", "kind"], out, log)
    assert rows_of(got.select("kind", "n")) == [("a", 3), ("b", 1)]


def test_short_quotas(spark):
    rows = spark.createDataFrame([(f"k{i}", "ab"[i % 2]) for i in range(10)], "id string, d string")
    quotas = spark.createDataFrame([("a", 3), ("b", 6), ("c", 1)], "d string, quota bigint")
    order = F.md5(F.col("id").cast("binary"))
    assert rows_of(ranking.short_strata(rows, quotas, "d")) == [("b", 6, 5), ("c", 1, 0)]
    assert ranking.quota_by(rows, quotas, "d", "id", order).count() == 8
    with pytest.raises(ValueError, match="b: 5 of 6"):
        ranking.quota_by(rows, quotas, "d", "id", order, strict=True)
    assert ranking.quota_by(rows, quotas.where("d = 'a'"), "d", "id", order, strict=True).count() == 3
