import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwright.operators import aggregates as G
from siftwright.operators import filters as P
from siftwright.operators import gates as V
from siftwright.operators import graph, joins, ranking, simjoin


def sets(n, seed, vocabulary=40):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 14))] for _ in range(n)]
    for k in range(0, n - 1, 3):
        base[k + 1] = base[k][: max(1, len(base[k]) - 1)] + ["w1"]
    return [(i, sorted(set(t)), f"d{i % 2}") for i, t in enumerate(base)] + [(n, None, "d0"), (n + 1, [], "d0"), (n + 2, ["only"], None)]


@pytest.mark.parametrize("measure", ["jaccard", "containment"])
@pytest.mark.parametrize("best", [False, True])
def test_reference_matches(spark, measure, best, monkeypatch):
    rows, ref = sets(80, 1), [(1000 + i, t) for i, t, _ in sets(50, 2) if t is not None]
    least = 3 if measure == "containment" else 0
    expected = {}
    for i, a, _ in rows:
        for j, b in ref:
            if a and b and len(a) >= max(least, 1) and len(b) >= least:
                c = len(set(a) & set(b))
                s = c / (min(len(a), len(b)) if measure == "containment" else len(set(a) | set(b)))
                if c and s >= 0.4:
                    expected[i, j] = s
    if best:
        top = {}
        for (i, j), s in sorted(expected.items()):
            if i not in top or s > top[i][1] + 1e-12:
                top[i] = (j, s)
        expected = {(i, j): s for i, (j, s) in top.items()}
    a = spark.createDataFrame([(i, t) for i, t, _ in rows], "id bigint, tokens array<string>")
    b = spark.createDataFrame(ref, "ref_id bigint, tokens array<string>")
    for limit in (10**6, 60):
        monkeypatch.setattr(simjoin.reference_blocks, "__defaults__", (limit,))
        got = {(r.id, r.ref_id): r.score for r in simjoin.reference_matches(a, b, measure, 0.4, least, best).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert simjoin.reference_matches(a, b.limit(0), measure, 0.4).collect() == []


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_jaccard_pairs(spark, threshold):
    rows = sets(150, 3, 25)
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>, d string")
    pairs, members = simjoin.jaccard_pairs(df, threshold, ["d"], spark)
    rep = {r.id: r.rep for r in members.collect()}
    known = {i: (set(t), d) for i, t, d in rows if t and d}
    assert rep.keys() == known.keys()
    for i, r in rep.items():
        assert known[i] == known[r] and r == min(j for j in known if known[j] == known[i])
    reps = sorted(set(rep.values()))
    expected = {(a, b) for a in reps for b in reps if a < b and known[a][1] == known[b][1]
                and len(known[a][0] & known[b][0]) / len(known[a][0] | known[b][0]) >= threshold}
    assert {(r.a, r.b) for r in pairs.collect()} == expected


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_containment_pairs(spark, threshold):
    rows = sets(120, 9, 30)
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>, d string")
    pairs, members = simjoin.containment_pairs(df, threshold, 3, ["d"], spark)
    known = {i: (set(t), d) for i, t, d in rows if t and d}
    reps = sorted(set(r.rep for r in members.collect()))
    expected = {(a, b) for a in reps for b in reps if a < b and known[a][1] == known[b][1] and min(len(known[a][0]), len(known[b][0])) >= 3
                and len(known[a][0] & known[b][0]) / min(len(known[a][0]), len(known[b][0])) >= threshold}
    assert {(r.a, r.b) for r in pairs.collect()} == expected and expected


def test_cosine(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(60)] + [(100, None, 0), (101, [], 0), (102, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, label int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    expected = {(q, i) for q, v, a in rows[:10] for i, w, b in rows[:60] if q != i and a == b and cos(v, w) >= 0.5}
    for block in (4096, 3):
        got = simjoin.cosine_hits(df, df.where("id < 10"), 0.5, "label", block).collect()
        assert {(r.query_id, r.id) for r in got} == expected
    best = {r.query_id: r.id for r in simjoin.cosine_hits(df, df.where("id < 10"), None).collect()}
    assert best == {q: max((i for i, _, _ in rows[:60] if i != q), key=lambda i: cos(rows[q][1], rows[i][1])) for q in range(10)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(90)] + [(200, 200 + i) for i in range(1, 120)] + [(5, 5), (None, 3)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    expected = {v: find(v) for v in list(parent)}
    for n in (1, 7):
        df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(n)
        got = graph.connected_components(df, spark).collect()
        assert {r.id: r.root for r in got} == expected and len(got) == len(expected)
    assert graph.connected_components(df.limit(0), spark).collect() == []


def test_reasons_and_families(spark):
    rows = [("a", "g", "d", "q", ["1", "2", "3", "4"], 0), ("b", None, "d", " ", ["1", "1 ", ""], 7), ("c", "g", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, group_id string, domain string, question string, options array<string>, gold int")
    good, bad = P.quarantine(df, P.item_reasons())
    assert [r.id for r in good.collect()] == ["a"]
    every = {r.reason: r.rows for r in P.reason_counts(bad).collect()}
    assert every["gold_out_of_range"] == 2 and every["repeated_option"] == 1 and every["option_count"] == 2
    assert sum(r.rows for r in P.reason_counts(bad, True).collect()) == 2
    assert [r.id for r in P.remove_families(df.where("group_id is not null"), df.where("id = 'c'")).collect()] == []


def test_exclusion_conservation_and_overlay(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, k string")
    b = spark.createDataFrame([(9, "x"), (None, None)], "id int, k string")
    assert [r.id for r in joins.exclude_any(a, b, ["id", "k"]).orderBy("id").collect()] == [2, 3]
    assert tuple(joins.conservation(a, a.where("id > 1").union(b), "id").first()) == (1, 2, 0)
    over = joins.overlay(a.select("id"), spark.createDataFrame([(1, "match")], "id int, verdict string"), ["id"], "verdict", "distinct")
    assert {r.id: r.verdict for r in over.collect()} == {1: "match", 2: "distinct", 3: "distinct"}


@pytest.mark.parametrize("groups", ["aabbbc", "aaaa", "abab", "aabaa", ""])
def test_circular_donor(spark, groups):
    import hashlib

    donors = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "donor_id bigint, donor_group string")
    rows = [(f"r{i}", "abcz"[i % 4]) for i in range(40)]
    expected = {}
    for i, g in rows:
        start = int(hashlib.sha256(f"s:{i}".encode()).hexdigest()[:8], 16) % max(1, len(groups))
        walk = [(start + k) % len(groups) for k in range(len(groups))]
        hit = next((w for w in walk if groups[w] != g), None)
        if hit is not None:
            expected[i] = hit
    got = joins.circular_donor(spark.createDataFrame(rows, "id string, group_id string"), donors, "s")
    assert {r.id: r.donor_id for r in got.collect()} == expected


def test_metrics(spark):
    rows = [("a", "x", 0, True), ("a", "x", 0, True), ("a", "x", 1, False), ("b", "y", 2, False), ("b", "y", 2, False)]
    df = spark.createDataFrame(rows, "id string, domain string, prediction int, correct boolean")
    m = G.macro_accuracy(df).first()
    assert abs(m.macro - 1 / 3) < 1e-9 and m.micro == 0.4 and m.rows == 5
    assert abs(G.view_agreement(df).first().agreement - (1 / 3 + 1) / 2) < 1e-9
    shares = {r.prediction: r.share for r in G.letter_shares(df).collect()}
    assert shares == {0: 0.4, 1: 0.2, 2: 0.4}
    assert G.macro_accuracy(df.limit(0)).first().rows is None


def test_bootstrap(spark):
    rng = random.Random(6)
    rows = [(i, f"d{i % 4}", rng.choice([-0.5, 0.0, 0.5])) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, domain string, delta double")
    r, again = G.bootstrap_interval(df, 2000).first(), G.bootstrap_interval(df.repartition(5), 2000).first()
    by = {d: [x for _, e, x in rows if e == d] for d in {e for _, e, _ in rows}}
    mean = sum(sum(v) / len(v) for v in by.values()) / len(by)
    sd = (sum((sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2) / len(v) for v in by.values())) ** 0.5 / len(by)
    assert abs(r.estimate - mean) < 1e-9 and abs(r.low - (mean - 1.96 * sd)) < 0.4 * sd and abs(r.high - (mean + 1.96 * sd)) < 0.4 * sd
    assert (r.low, r.high) == (again.low, again.high)


def test_apportion(spark):
    weights = {"a": 3, "b": 3, "c": 1, "d": 0}
    for total in (0, 1, 5, 7, 100):
        table = {r.domain: r.quota for r in ranking.apportion_table(
            spark.createDataFrame(list(weights.items()), "domain string, weight bigint"), spark.createDataFrame([(total,)], "total bigint"), "s").collect()}
        assert table == ranking.apportion(weights, total, "s") and sum(table.values()) == total


def test_whole_groups(spark):
    assert ranking.whole_group_subset([("a", 5), ("b", 3), ("c", 2)], 5) == ["a"]
    assert ranking.whole_group_subset([("a", 4), ("b", 3), ("c", 2)], 5) == ["b", "c"]
    assert ranking.whole_group_subset([("a", 4)], 3) is None and ranking.whole_group_subset([], 0) == []
    rng = random.Random(7)
    groups = [(f"d{d}", f"g{d}-{i}", rng.randrange(1, 6)) for d in range(3) for i in range(30)] + [("tiny", "t", 2)]
    got = ranking.allocate_whole_groups(spark.createDataFrame(groups, "domain string, group_id string, n bigint"), {"dev": 20, "test": 10}, "train", "s").collect()
    size = {g: n for _, g, n in groups}
    totals = Counter()
    for r in got:
        totals[r.domain, r.split] += size[r.group_id]
    for d in range(3):
        assert totals[f"d{d}", "dev"] == 20 and totals[f"d{d}", "test"] == 10
    assert len(got) == 90 and not any(r.domain == "tiny" for r in got)


def test_bins_and_buckets():
    rng = random.Random(8)
    for _ in range(40):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 25))]
        bins = ranking.budget_bins(lengths, 60)
        at, expected, k = 0, [], 0
        while at < len(lengths):
            size = len(lengths) - at
            while size > 1 and max(lengths[at : at + size]) * size > 60:
                size -= 1
            expected += [k] * size
            at, k = at + size, k + 1
        assert bins == expected


def test_sequential_and_stale(spark):
    df = spark.createDataFrame([("a", "d1", "s1"), ("b", "d1", "s1"), ("c", "d2", "s1"), ("d", "d2", "s2")], "id string, domain string, signature string")
    got = {r.id for r in ranking.sequential_quota(df, [("d1", 5), ("d2", 5)], "signature", ["id"]).collect()}
    assert got == {"a", "d"}
    h = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, 0.9, 0.895, 0.9, 0.5])], "run int, step bigint, loss double")
    assert [r.stale for r in ranking.stale_counts(h, "step", "loss", 0.05).orderBy("step").collect()] == [0, 0, 1, 2, 0]


def test_gates(spark):
    checks = spark.createDataFrame([("a", True), ("b", None)], "name string, ok boolean")
    assert tuple(V.gate(checks).first()) == (False, 1) and tuple(V.gate(checks.limit(0)).first()) == (False, 0)
    text = V.manifest("PASSED", spark.createDataFrame([("rows", 3)], "name string, n bigint"), {"t": 0.8}, {"in": "ff"})
    assert V.require_status(text, "PASSED")["counts"] == {"rows": 3}
    with pytest.raises(ValueError):
        V.require_status(text, "OTHER")
    df = spark.sql("select named_struct('x', array(named_struct('secret', 1))) as s")
    assert V.private_fields(df.schema, {"secret"}) == ["s.x[].secret"]
    scored = spark.createDataFrame([(1, 2, 0.9, "t"), (1, 3, 0.9, "t"), (4, 2, 0.1, "t")], "candidate_id int, matched_id int, score double, text string")
    packet, public = V.audit_packet(scored, 2, spark.createDataFrame([(1, 3, "match")], "candidate_id int, matched_id int, verdict string"))
    assert "text" not in public.columns
    assert sorted((r.rank, r.matched_id, r.verdict) for r in public.collect()) == [(1, 2, "pending"), (2, 3, "match")]
    assert packet.count() == 2


def test_quota_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", None, 1), ("d", "y", 0)], "id string, d string, k int")
    q = spark.createDataFrame([("x", 1), ("y", 5), ("z", 3)], "d string, quota bigint")
    assert {r.id for r in ranking.quota_by(df, q, "d", "id", F.md5(F.lit("same"))).collect()} == {"a", "d"}
    assert {r.id for r in ranking.first_by(df, ["d"], "k", "id").collect()} == {"a", "c", "d"}
    ranked = ranking.rank_in_hash_order(df.withColumn("h", F.md5("id")), ["k"], "id", "h").collect()
    assert {(r.k, r["rank"]) for r in ranked} == {(1, 0), (1, 1), (1, 2), (0, 0)} and {r.group_rows for r in ranked} == {3, 1}
    assert {(r.id, r.place) for r in ranking.place_in_order(df, "k", "id").collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 1)}
    assert [r.id for r in ranking.top_k(df, 2, "k", "id").orderBy("rank").collect()] == ["d", "a"]
    assert df.groupBy().agg(F.count("*")).first()[0] == 4
