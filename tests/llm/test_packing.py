import random

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwright.llm import packing


def first_fit_decreasing(sizes, capacity):
    bins = []
    for n in sorted(sizes, reverse=True):
        for b in bins:
            if sum(b) + n <= capacity:
                b.append(n)
                break
        else:
            bins.append([n])
    return sorted(map(sorted, bins))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 40))
def test_pack(sizes, capacity):
    pieces = packing.pack(sizes, capacity)
    bins = {}
    for n, parts in zip(sizes, pieces):
        assert sum(p[2] for p in parts) == max(n, 0)
        assert [p[1] for p in parts] == list(range(0, max(n, 0), capacity))
        assert len(parts) <= 1 or n > capacity
        for c, _, size in parts:
            bins.setdefault(c, []).append(size)
    assert all(sum(b) <= capacity for b in bins.values())
    if all(n <= capacity for n in sizes):
        assert sorted(map(sorted, bins.values())) == first_fit_decreasing([n for n in sizes if n], capacity)


def test_texts_are_whole_and_capacity_holds(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["lago", "ponte", "è", "già"]) for _ in range(rng.randrange(1, 300)))) for i in range(300)]
    texts += [(1000, "parola " * 5000), (1001, ""), (1002, None), (None, "x"), (1003, "una"), (1003, "una")]
    df = spark.createDataFrame([(*t, 5) for t in texts], "doc_id bigint, text string, tokens int")
    budgets = spark.createDataFrame([(1, "a", 64), (2, "b", 512), (3, "c", None), (4, "d", 0)], "budget_id int, budget_name string, capacity_tokens bigint")
    got = packing.pack_texts(df, budgets, spark, group_rows=100).collect()
    enc = packing.encoder(packing.VOCABULARY)
    size = {d: len(enc.encode_ordinary(t)) for d, t in texts if t and d is not None}
    size[1003] *= 2
    for budget, capacity in ((1, 64), (2, 512)):
        total, bins = {}, {}
        for r in got:
            if r.budget_id == budget:
                total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
                bins[r.group_no, r.container] = bins.get((r.group_no, r.container), 0) + r.tokens
                assert r.piece == 0 or size[r.doc_id] > capacity
        assert total == size
        assert max(bins.values()) <= capacity
    again = packing.pack_texts(df.repartition(7), budgets, spark, group_rows=100).collect()
    assert sorted(got) == sorted(again)
    assert packing.pack_texts(df.limit(0), budgets, spark).collect() == []
