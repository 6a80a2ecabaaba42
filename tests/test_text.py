import pytest
from pyspark.sql import functions as F

from siftwright.functions import arrays as A
from siftwright.functions import keys as K
from siftwright.functions import pytext
from siftwright.functions import text as X


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


CASES = [None, "", "  ", "Perché NO?", "Straße", "l’età  è\n“mia”", "été", "0", "x" * 20_000]


def test_normal_forms_agree_with_python(spark):
    rows = [(c,) for c in CASES]
    assert values(spark, X.norm_fold(F.col("t")), rows, "t string") == [pytext.norm_fold(c) for c in CASES]
    assert values(spark, X.norm_keep(F.col("t")), [(c,) for c in CASES if c != "Straße" and c != "été"], "t string") == [
        pytext.norm_keep(c) for c in CASES if c != "Straße" and c != "été"
    ]
    assert values(spark, X.norm_fold_full(F.col("t")), rows, "t string") == [pytext.norm_fold(c) for c in CASES]


@pytest.mark.parametrize("depth", [0, 1, 3, 8])
def test_unescape_depth(depth):
    text = "è"
    for k in range(depth):
        text = "&egrave;" if k == 0 else text.replace("&", "&amp;")
    assert pytext.unescape(text) == "è"


def test_words_and_shingles(spark):
    rows = [("La casa rossa e la porta blu",), ("uno due",), ("",), (None,), ("alba " * 5,)]
    words = X.content_words(X.norm_fold(F.col("t")))
    assert values(spark, words, rows, "t string") == [["casa", "rossa", "porta", "blu"], ["due"], [], [], ["alba"] * 5]
    assert values(spark, X.word_shingles(words), rows, "t string") == [["casa rossa porta", "rossa porta blu"], ["due"], [], [], ["alba alba alba"]]


def test_predicates(spark):
    rows = [("nel 1492",), ("nel 2005",), ("la guerra mondiale",), ("oggi nel 1900",), ("cap 92131",), ("",)]
    t = X.norm_fold(F.col("t"))
    assert values(spark, X.is_stable_history(t), rows, "t string") == [True, False, True, False, False, False]
    assert values(spark, X.is_current(t), rows, "t string") == [False, True, False, True, False, False]


def test_domain_rules(spark):
    rows = [("Storia dell'arte", None), ("Storia", "x"), ("Attualità e storia", None), (None, None), ("Lessico", "Geografia")]
    assert values(spark, X.map_domain(F.col("a"), F.col("b")), rows, "a string, b string") == ["art_history", "history", None, None, "geography"]


def test_spelling_variants(spark):
    got = values(spark, X.spelling_variants(F.col("w")), [("acqua",), ("ab",), (None,)], "w string")
    assert {"accqua", "aqcua", "aqua", "accua"} & set(got[0]) and "acqua" not in got[0] and got[1] == [] and got[2] == []


def test_mask_needs_exactly_one(spark):
    rows = [("Il gatto dorme.", "gatto"), ("gatto e gatto", "gatto"), ("niente", "gatto"), (None, "x")]
    assert values(spark, X.mask_once(F.col("s"), F.col("w")), rows, "s string, w string") == ["Il ____ dorme.", None, None, None]


def test_answers_and_options(spark):
    rows = [("B",), (" C.",), ("xZ",), (None,), ("",)]
    parts = X.parse_answer(F.col("o"))
    assert values(spark, parts["valid"], rows, "o string") == [True, True, False, False, False]
    assert values(spark, parts["exact"], rows, "o string") == [True, False, False, False, False]
    rows = [("testo",), ('{"value": "v"}',), ('{"A": "a"}',), (None,)]
    assert values(spark, X.option_value(F.col("o")), rows, "o string") == ["testo", "v", "a", None]


def test_keys(spark):
    rows = [("Che?", ["b", "A"]), ("CHE", ["a", "B"]), ("Che?", ["b"])]
    a, b, c = values(spark, K.record_key(F.col("q"), F.col("o")), rows, "q string, o array<string>")
    assert a == b != c
    assert values(spark, K.hash_int(F.lit("ff" * 32), 16), [(1,)], "x int") == [2**64 - 1]


def test_permutations(spark):
    df = spark.range(24).select(A.permutation(F.col("id")).alias("o"))
    rows = df.select("o", A.inverse(F.col("o")).alias("i"), A.to_semantic(A.to_display(F.array(*[F.lit(x) for x in "abcd"]), F.col("o")), F.col("o")).alias("s")).collect()
    assert rows[0].o == [0, 1, 2, 3] and len({tuple(r.o) for r in rows}) == 24
    for r in rows:
        assert [r.o[k] for k in r.i] == [0, 1, 2, 3] and r.s == list("abcd")
    orders = spark.range(50).select(A.view_orders(F.col("id")).alias("v")).collect()
    assert all(r.v[0] == [0, 1, 2, 3] and len({tuple(o) for o in r.v}) == 4 for r in orders)
    others = spark.range(200).select(A.other_order(F.col("id"), F.lit(0)).alias("o")).collect()
    assert all(r.o != [0, 1, 2, 3] for r in others)


def test_probability_vectors(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.4, 0.1], 2)], "p array<double>, g int")
    r = df.select(
        A.top1(F.col("p")).alias("t"), A.kl(F.col("p"), F.col("p")).alias("k"), A.js(F.col("p"), F.reverse("p")).alias("j"),
        A.reindexed(F.col("p"), F.array(F.lit(1), F.lit(2), F.lit(None).cast("int"))).alias("q"),
        A.pinned_order(F.lit(4), F.col("g"), F.lit(3), F.lit("s")).alias("o"), A.drop_option(F.col("p"), F.array(*[F.lit(k) for k in range(4)]), F.lit(1)).alias("d"),
    ).first()
    assert r.t == 1 and r.k == 0 and abs(r.j) < 1e-12 and abs(sum(r.q) - 1) < 1e-12 and r.o[3] == 2 and sorted(r.o) == [0, 1, 2, 3] and r.d is None
