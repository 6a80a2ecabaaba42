import importlib
import os
import subprocess
import sys

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_need_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_optional_part():
    code = "import sys; sys.modules['siftwright.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 100


def test_some_queries_equal_their_sql(spark):
    import duckdb

    registry = importlib.import_module("siftwright.plans.registry")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    for name in ("containment_decontam", "near_dup_pairs", "family_ids", "largest_feasible_total", "circular_donors", "tail_packet", "mean_posterior", "conllu_tokens"):
        got = registry.queries()[name](spark, SMALL)
        names = sorted(got.columns)
        rows = sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect())))
        rel = con.sql(f"select {', '.join(names)} from ({registry.oracle_sql()[name]})" if not registry.oracle_sql()[name].startswith("with recursive") else registry.oracle_sql()[name])
        order = [rel.columns.index(c) for c in names]
        assert rows == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall()), name
