import random

import pyarrow as pa

from siftwright.llm import copies


def test_what_is_a_copy(spark):
    rows = [
        ("b", "Qual è la capitale?", ["Roma", "Pisa"]), ("a", " QUAL   è\nla capitale ", ["- pisa", "roma."]), ("c", "Qual &egrave; la capi​tale?", ["Pisa", "Roma"]),
        ("d", "Qual e la capitale?", ["Roma", "Pisa"]), ("e", "Anno １９４０?", None), ("f", "anno 1940", []), ("g", "Anno 1940", [None]), ("h", " ... ", ["Roma"]),
        ("i", None, ["Roma"]), (None, "Anno 1940", None), ("a", "Qual è la capitale?", ["Roma", "Pisa"]), ("j", "x" * 50_000, ["y"]), ("k", "X" * 50_000, ["Y"]),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, question string, options array<string>, key string")
    members, whole = copies.collapse(df, spark)
    assert {tuple(r) for r in members.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e"), ("j", "j"), ("k", "j")}
    assert {tuple(r) for r in whole.collect()} == {("a", 3), ("e", 2), ("j", 2)}
    members, whole = copies.collapse(df.limit(0), spark)
    assert members.collect() == [] and whole.collect() == []


def test_one_set_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(f"hot{i:05d}", "La stessa domanda", ["sì", "no"]) for i in range(4000)] + [(f"x{i}", f"Domanda {rng.randrange(900)}", ["a"]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, question string, options array<string>").repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        members, whole = copies.collapse(df, spark)
        members, whole = members.collect(), whole.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    groups = {}
    for i, q, _ in rows:
        groups.setdefault(q, set()).add(i)
    expected = {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}
    assert {tuple(r) for r in members} == expected and len(members) == len(expected)
    assert {tuple(r) for r in whole} == {(min(g), len(g)) for g in groups.values() if len(g) > 1}


def test_scan_compares_full_keys():
    """Different keys under one hash stay apart, also in the hash at either end."""
    rows = [(1, "a", "i1"), (1, "a", "i2"), (1, "b", "i1"), (2, "c", "i5"), (2, "d", "i6"), (2, "d", "i6"), (2, "d", "i7"), (3, "e", "i8"), (3, "f", "i9")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["h", "key", "id"])
    out = [r for b in copies.scan_runs(iter([batch.slice(0, 4), batch.slice(4)]), 0) for r in b.to_pylist()]
    runs = {(r["h"], r["key"], r["keeper_id"]): r["copies"] for r in out if r["id"] is None}
    assert runs == {(1, "a", "i1"): 2, (1, "b", "i1"): 1, (None, None, "i6"): 2, (3, "e", "i8"): 1, (3, "f", "i9"): 1}
    assert {(r["id"], r["keeper_id"]) for r in out if r["id"]} == {("i1", "i1"), ("i2", "i1"), ("i6", "i6"), ("i7", "i6"), ("i8", "i8"), ("i9", "i9")}
