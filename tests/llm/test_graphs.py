import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftwright.llm import bundles, components
from siftwright.session import Scratch


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return parent, find


def parts(pairs):
    groups = {}
    for v, r in pairs:
        groups.setdefault(r, set()).add(v)
    return {frozenset(g) for g in groups.values()}


def brute(edges):
    parent, find = roots([e for e in edges if e[0] != e[1]])
    return parts((v, find(v)) for v in list(parent))


def shapes():
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    loops = [(5000, 5000), (5001, 5001)]
    mixed = [(rng.randrange(6000, 6300), rng.randrange(6000, 6300)) for _ in range(180)]
    return chain + star + loops + mixed + chain[:5] + [(b, a) for a, b in star[:9]]


@pytest.mark.parametrize("method", [components.contract, bundles.grow])
def test_components_of_chains_stars_and_loops(spark, method):
    edges = shapes()
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = [(r.v, r.root) for r in method(df, Scratch(spark, "t")).collect()]
    assert len(got) == len({v for v, _ in got})
    assert parts(got) == brute(edges)


@pytest.mark.parametrize("method", [components.contract, bundles.grow])
def test_no_edges(spark, method):
    df = spark.createDataFrame([(1, 1)], "a bigint, b bigint")
    assert method(df, Scratch(spark, "t")).collect() == []


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_both_methods_agree(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for method in (components.contract, bundles.grow):
        assert parts((r.v, r.root) for r in method(df, Scratch(spark, "t")).collect()) == brute(edges)


def test_consolidate(spark):
    pairs = [
        ("s:A1", "s:B2"), (" S:b2 ", "s:c3"), ("s:c3", "s:C3"), ("x:1", "x:1"), (None, "s:A1"), ("s:A1", "gone:9"), ("", "s:A1"), ("m:1", "M:2"),
        ("m:1", "m:2"),
    ]
    names = [("s:A1", 1), ("s:B2", 1), ("s:C3", 1), ("s:C3", 2), ("x:1", 1), ("m:1", 1), ("m:2", 1), (None, 1)]
    p = spark.createDataFrame(pairs, "left_id string, right_id string")
    n = spark.createDataFrame(names, "id string, root_id int")
    got = sorted(map(tuple, components.consolidate(p, n, spark).collect()))
    assert got == [("m:1", "m:1"), ("m:2", "m:1"), ("s:A1", "s:A1"), ("s:B2", "s:A1"), ("s:C3", "s:A1")]
    assert components.consolidate(p.limit(0), n, spark).collect() == []


ROWS = [
    ("1", "G1", "s1"), ("2", " g1 ", "S2"), ("3", "g2", "s2 "), ("4", "g3", "s3"), ("5", None, "s3"), ("6", "g4", None), ("7", None, None),
    ("8", "g5", "s5"), ("9", "g6", "s5"), ("10", "g6", "s1"), ("10", "g6", "s1"), (None, "g9", "s9"), ("11", None, "s77"), ("12", None, "s77"),
]


def test_tied_groups(spark):
    df = spark.createDataFrame(ROWS, "id string, group_id string, source_id string")
    got = sorted(map(tuple, bundles.tie_groups(df, spark).collect()))
    assert got == [(g, "g1") for g in ("g1", "g2", "g5", "g6")]
    assert bundles.tie_groups(df.limit(0), spark).collect() == []


def test_splits_keep_ties_and_shares(spark):
    rng = random.Random(5)
    rows = [(str(i), f"g{rng.randrange(700)}" if i % 9 else None, f"s{rng.randrange(2500)}" if i % 7 else None) for i in range(3000)]
    rows += [(f"h{i}", "hot", None) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, group_id string, source_id string")
    got = {r.id: r.split for r in bundles.assign(df, spark).collect()}
    again = {r.id: r.split for r in bundles.assign(df.repartition(7), spark).collect()}
    assert got == again and len(got) == len(rows)
    for column in (1, 2):
        seen = {}
        for r in rows:
            if r[column] is not None:
                assert seen.setdefault(r[column], got[r[0]]) == got[r[0]]


def test_split_shares(spark):
    w = spark.createDataFrame([(f"b{i}", 1 + i % 5) for i in range(4000)], "bundle string, n bigint")
    share = {}
    for r in bundles.split_bundles(w).collect():
        share[r.split] = share.get(r.split, 0) + r.n
    total = sum(share.values())
    for name, target in bundles.PROPORTIONS:
        assert abs(share[name] / total - target) < 0.01
