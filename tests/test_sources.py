import io
import zipfile

import pytest

from siftwright.sources import conllu, files, records
from siftwright.streaming import views

BLOCKS = """# sent_id = s1
# text = Il gatto dorme
1\tIl\til\tDET\t_\tGender=Masc|Number=Sing\t2\tdet\t_\t_
2-3\tx\t_\t_\t_\t_\t_\t_\t_\t_
2\tgatto\tgatto\tNOUN\t_\t_\t3\tnsubj:pass\t_\t_
3\tdorme\tdormire\tVERB\t_\tMood=Ind\t0\troot\t_\t_

# other
1\tSì\tsì\tINTJ\t_\t_\t_\troot\t_\t_

# text = niente
"""


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(BLOCKS, encoding="utf-8")
    rows = sorted(conllu.read_conllu(spark, str(tmp_path / "a.conllu")).collect(), key=lambda r: r.text)
    assert [r.text for r in rows] == ["Il gatto dorme", "Sì"] and rows[0].sent_id == "s1" and rows[1].sent_id.startswith("anonymous:")
    t = rows[0].tokens
    assert [x.id for x in t] == [1, 2, 3] and t[0].feats == {"Gender": "Masc", "Number": "Sing"} and t[1].deprel == "nsubj" and t[1].feats == {} and t[2].head == 0


TABLE = (
    "AB12345  Quale parola è      a) casa         b) cane       c) sole      d) mare      B\n"
    "         scritta bene?          rossa\n"
    "Vietata la pubblicazione\n"
    "AB12346  Domanda             a) uno          b) uno        c) due       d) tre       A\n"
    "AB12347  Senza opzioni\n"
)


def test_printed_records():
    rows = list(records.parse_table(TABLE))
    assert [r["reason"] for r in rows] == ["accepted", "repeated_option", "columns"]
    assert rows[0]["question"] == "Quale parola è scritta bene?" and rows[0]["options"] == ["casa rossa", "cane", "sole", "mare"]
    assert rows[0]["gold"] == 1 and rows[0]["gold_text"] == "cane"
    assert list(records.parse_table("")) == []


def test_printed_records_are_not_cut(spark, tmp_path):
    from siftwright.plans.sources import printed_records

    question, options = " ".join(["parola"] * 90) + " fine?", [" ".join([w] * 50) + " fine" for w in ("uno", "due", "tre", "sei")]
    df = spark.createDataFrame([("x:AB12345", "AB12345", question, options, 3)], "id string, record_code string, question string, options array<string>, gold int")
    df.write.parquet(str(tmp_path / "zagreus_exam_bank_v1.parquet"))
    (row,) = printed_records(spark, str(tmp_path)).collect()
    assert (row.question, row.gold, row.gold_letter, row.reason) == (question, 3, "D", "accepted")


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/one.txt", TABLE)
        z.writestr("skip/two.txt", TABLE)
        z.writestr("three.bin", b"x")
    (tmp_path / "x.zip").write_bytes(buffer.getvalue())
    found = records.read_archives(spark, str(tmp_path / "x.zip"), exclude="skip/")
    assert [r.member for r in found.collect()] == ["a/one.txt"]
    parsed = records.parse_tables(found.select("member", "text")).collect()
    assert [r.reason for r in parsed] == ["accepted", "repeated_option", "columns"] and parsed[1].gold is None


def test_jsonl(spark, tmp_path):
    path, schema = str(tmp_path / "j"), "id string, t string"
    df = spark.createDataFrame([("b", "è"), ("a", None)], schema)
    files.write_jsonl(df, path, order=["id"])
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "j").glob("part-*")))
    assert text == '{"id":"a","t":null}\n{"id":"b","t":"è"}\n'
    assert files.append_pending(df, str(tmp_path / "k"), schema) == 2 and files.append_pending(df, str(tmp_path / "k"), schema) == 0
    assert files.discover(spark, str(tmp_path), r"part-.*\.json$", ["k"]).where("path like '%/j/%'").count() >= 1
    (tmp_path / "bad.json").write_text('{"id": 1\n')
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.read_jsonl(spark, str(tmp_path / "bad.json"), schema).collect()
    assert files.read_json_document(files.write_json_document({"b": 1, "a": "è"})) == {"a": "è", "b": 1}


def test_protected(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(3).coalesce(1).write.parquet(path)
    assert files.load_protected(spark, path, 3).count() == 3
    with pytest.raises(ValueError):
        files.load_protected(spark, path, 4)
    with pytest.raises(ValueError):
        files.load_protected(spark, path, 3, "00")


def test_complete_views_over_two_runs(spark, tmp_path):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    schema = "id string, view int, top1 int"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = views.complete_views(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, list(r.top1)) for r in spark.read.schema(stream.schema).parquet(out).collect())

    assert run([("a", 0, 1), ("a", 1, 1), ("b", 0, 2), ("a", 1, 9), (None, 0, 0)]) == []
    assert run([("a", 2, 3), ("a", 3, 0), ("a", 3, 0), ("b", 1, 2)]) == [("a", [1, 1, 3, 0])]
    assert run([("a", 0, 5)]) == [("a", [1, 1, 3, 0])]
