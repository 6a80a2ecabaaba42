"""One key, source or set of copies with a third of all rows: whole results, whatever the layout."""

import random

from siftwright.llm import bundles, ledger, overlap, quota, residue
from siftwright.operators.ranking import rank_in_hash_order
from siftwright.llm.common import hash_hex

OPTS = ["uno", "due", "tre", "quattro"]


def test_copies_of_one_item_in_both_splits(spark):
    q = "Chi dipinse la sala di Velagna nel 1440 per conto di Mezia Tolli?"
    rows = [(f"t{i:03d}", overlap.TRAINING, q, OPTS, 1, "due") for i in range(120)] + [(f"e{i:03d}", "proxy_dev", q.upper(), OPTS[::-1], 2, "due") for i in range(40)]
    rows += [(f"x{i}", "proxy_dev" if i % 2 else overlap.TRAINING, q.replace("1440", str(2000 + i)), OPTS, 1, "due") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, source_split string, question string, options array<string>, gold int, answer string")
    got = overlap.find_overlaps(df, spark).collect()
    assert len(got) == 120 * 40 and len({(r.train_id, r.eval_id) for r in got}) == 120 * 40


def test_one_source_ties_a_third_of_the_groups(spark):
    rng = random.Random(1)
    rows = [(f"h{i}", f"hot{i}", "S") for i in range(600)] + [(f"r{i}", f"g{rng.randrange(900)}", f"s{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, group_id string, source_id string").repartition(6)
    got = {r.group_id: r.bundle_id for r in bundles.tie_groups(df, spark).collect()}
    assert got == {f"hot{i}": "hot0" for i in range(600)}
    splits = {r.id: r.split for r in bundles.assign(df, spark).collect()}
    assert len(splits) == 1800 and len({splits[f"h{i}"] for i in range(600)}) == 1


def test_one_key_with_a_third_of_the_rows(spark, tmp_path):
    rows = [(f"h{i}", "S", "G", 1 + i % 3) for i in range(500)] + [(f"r{i}", f"s{i}", "g", 1 + i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, source_id string, group_id string, snapshot_no int")
    whole = {r.id for r in ledger.ledger_sample(df, spark, str(tmp_path / "a"), rate=0.3).collect()}
    assert len(whole & {f"h{i}" for i in range(500)}) in (0, 500)
    assert whole == {r.id for r in ledger.ledger_sample(df.repartition(5), spark, str(tmp_path / "b"), rate=0.3).collect()}


def test_ranks_of_a_dominant_category(spark):
    df = spark.createDataFrame([(f"i{k}", "a" if k % 3 else "b") for k in range(3000)], "id string, d string")
    ranked = rank_in_hash_order(df.withColumn("h", hash_hex("s", df.id)), ["d"], "id", "h").collect()
    for d, n in (("a", 2000), ("b", 1000)):
        assert sorted(r["rank"] for r in ranked if r.d == d) == list(range(n))
    targets = spark.createDataFrame([(1, "a", 1.0, 0, 1500)], "request_id int, domain string, target_share double, min_rows bigint, sample_size bigint")
    people = quota.members(df.withColumnRenamed("d", "domain"))
    assert quota.draw(people, quota.allocation(people, targets)).count() == 1500


def test_one_message_in_a_third_of_the_documents(spark):
    rows = [(i, f"s{i % 7}", "404 Not Found" if i % 3 == 0 else f"Il notaio lesse la pagina {i}.") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    flagged, groups = residue.find_residue(df, spark)
    assert {r.doc_id for r in flagged.collect()} == set(range(0, 900, 3))
    assert [(r.unit, r.documents, r.sources) for r in groups.collect()] == [("<n> not found", 300, 7)]
