import random

import pytest

from siftwright.llm import overlap as O

SCHEMA = "id string, source_split string, question string, options array<string>, gold int, answer string, train string, h1 int"
Q = "Chi scrisse «Carta», il romanzo ambientato a Velagna e stampato nel 1440 a spese di Mezia Tolli?"
OPTS = ["Gino Rossi", "Vezia Banti", "Tosco Murri", "Pina Saldi"]


def found(spark, rows):
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    return {(r.train_id, r.eval_id) for r in O.find_overlaps(df, spark).collect()}


def row(i, split, q=Q, o=None, gold=0, answer=None):
    return (i, split, q, OPTS if o is None else o, gold, answer)


ALIKE = {
    "case": Q.upper(),
    "spaces": "  Chi scrisse  «Carta»,\n il romanzo ambientato a Velagna e stampato nel 1440 a spese di Mezia Tolli ? ",
    "escapes": Q.replace("«", "&amp;laquo;").replace("»", "&raquo;"),
    "quotes": Q.replace("«", '"').replace("»", '"'),
    "intro": "Leggi con attenzione. " + Q,
    "bracket": "(Livello base) " + Q,
    "phrase": "Secondo il testo, chi" + Q[3:],
    "word": Q.replace("ambientato", "collocato"),
    "slip": Q.replace("romanzo", "romnazo"),
    "added": Q.replace("stampato", "poi stampato"),
}
OTHER = {
    "person": Q.replace("Mezia", "Dozia"),
    "place": Q.replace("Velagna", "Dumira"),
    "number": Q.replace("1440", "1441"),
    "quoted": Q.replace("Carta", "Sale"),
}


@pytest.mark.parametrize("kind", ALIKE)
def test_same_item(spark, kind):
    assert found(spark, [row("t", O.TRAINING), row("e", "proxy_dev", ALIKE[kind])]) == {("t", "e")}


@pytest.mark.parametrize("kind", OTHER)
def test_other_item(spark, kind):
    assert found(spark, [row("t", O.TRAINING), row("e", "proxy_dev", OTHER[kind])]) == set()


def test_options(spark):
    base = row("t", O.TRAINING)
    turned = row("turned", "proxy_dev", o=OPTS[::-1], gold=3)
    typo = row("typo", "proxy_dev", o=["Gino Rossi", "Vezia Bnati", *OPTS[2:]])
    right_typo = row("right", "proxy_dev", o=["Gino Rosssi", *OPTS[1:]])
    other_gold = row("gold", "proxy_dev", gold=1)
    other_set = row("set", "proxy_dev", o=[*OPTS[:3], "Aldo Neri"])
    three = row("three", "proxy_dev", o=OPTS[:3])
    by_answer = row("answer", "proxy_dev", gold=None, answer="gino rossi")
    lost = row("lost", "proxy_dev", gold=9)
    rows = [base, turned, typo, right_typo, other_gold, other_set, three, by_answer, lost]
    assert found(spark, rows) == {("t", "turned"), ("t", "typo"), ("t", "answer")}


def test_defined_results(spark):
    rows = [
        row("t", O.TRAINING), row("t", O.TRAINING), row("t2", O.TRAINING, "x " * 30_000 + Q), row("e", "proxy_dev"), row("e", "proxy_dev"),
        row(None, "proxy_dev"), row("nosplit", None), row("blank", "proxy_dev", " ? "), row("noq", "proxy_dev", None),
        ("noopts", "proxy_dev", Q, None, 0, None), ("nullopt", "proxy_dev", Q, [None, "a", "b", "c"], 0, None), row("e2", "lr_calibration"),
    ]
    assert found(spark, rows) == {("t", "e"), ("t", "e2")}
    assert found(spark, []) == set()


def test_partitioning_does_not_matter(spark):
    rows = [row(f"t{i}", O.TRAINING, Q.replace("1440", str(1400 + i % 7))) for i in range(40)]
    rows += [row(f"e{i}", "proxy_dev", ("Secondo il testo, " if i % 2 else "") + Q.replace("1440", str(1400 + i % 7))) for i in range(20)]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    expected = {(f"t{i}", f"e{j}") for i in range(40) for j in range(20) if i % 7 == j % 7}
    for n in (1, 9):
        assert {(r.train_id, r.eval_id) for r in O.find_overlaps(df.repartition(n), spark).collect()} == expected


def test_slips():
    assert O.slip("gerundio presente", "gerundo presente")
    assert not O.slip("1500", "1501")
    assert not O.slip("perse", "lesse")
    assert O.same_options(["a", "b", "c"], ["a", "b", "c"])
    assert not O.same_options(["a", "b", "c"], ["a", "b", "d"])


ENUMERATORS = ["12) ", "12. ", "12 - ", "(12) ", "[7] ", "b) ", "B) ", "B. ", "c. ", "IV) ", "n. 12: ", "Domanda 12: ", "Quesito n. 3 - ", "Domanda a risposta unica. 12) "]


def test_leading_item_numbers(spark):
    rows = [row("t", O.TRAINING), row("t9", O.TRAINING, "9) " + Q)] + [row(f"e{k}", "proxy_dev", p + Q) for k, p in enumerate(ENUMERATORS)]
    assert found(spark, rows) == {(t, f"e{k}") for t in ("t", "t9") for k in range(len(ENUMERATORS))}


def test_numbers_that_are_no_item_numbers():
    for text in ("1440 - anno di Carta", "3.5 litri di acqua sono quanti?", "12. Oktober 1492: wer landete?", "D. Tolli scrisse quale libro?", "5 - 3 quanto fa?", "12 navi salparono da dove?"):
        assert O.without_enumerator(text) == text


def test_every_accepted_pair_meets():
    """Pairs that the comparison accepts share a key, whatever was changed, dropped, added or put in front."""
    rng = random.Random(5)
    small = "alba bosco conte duna erba fiume grano isola lago monte notte orto ponte riva sale torre".split()
    names = ["Velagna", "Mezia", "Tolli", "Dumira", "Brando"]
    accepted = 0
    for _ in range(4000):
        words = [rng.choice(small) + rng.choice("aei") for _ in range(rng.randrange(4, 22))]
        for n in rng.sample(names, rng.randrange(3)):
            words.insert(rng.randrange(1, len(words)), n)
        a, b = list(words), list(words)
        for side in (a, b):
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(side))
                if side[at] not in names:
                    side[at : at + 1] = rng.choice(([], ["altro"], [side[at], "poi"], [rng.choice(small)]))
                    side = side or ["x"]
        b = [rng.choice(small) + "u" for _ in range(rng.randrange(9))] + b
        turn = rng.choice((str, str.upper, str.title, str.lower))
        ta, tb = turn(" ".join(a)), rng.choice((str, turn))(" ".join(b))
        (wa, ka), (wb, kb) = O.tokenise(ta), O.tokenise(tb)
        if not wa or not wb or not O.same_question(wa, ka, wb, kb):
            continue
        accepted += 1
        x, y = O.join_keys(wa, ka, "r", ["p", "q", "s"]), O.join_keys(wb, kb, "r", ["p", "t", "u"])
        assert x[0] in y[1] or y[0] in x[1] or set(x[2] or ()) & set(y[2] or ()), (ta, tb)
    assert accepted > 1000


def test_report_counts_without_expanding(spark):
    rows = [row(f"t{i}", O.TRAINING) for i in range(6)] + [row(f"e{i}", "proxy_dev", Q if i % 2 else "Leggi con attenzione. " + Q.replace("ambientato", "posto")) for i in range(8)]
    rows += [row("both", O.TRAINING), row("both", "proxy_dev"), row("two", "proxy_dev"), row("two", "proxy_dev", Q.replace("stampato", "poi stampato"))]
    rows += [row("lone", "lr_calibration", Q.replace("1440", "1441")), row("z", "lr_calibration", Q.lower())]
    df = spark.createDataFrame([(*r, None, f"s{len(r[0]) % 2}") for r in rows], "id string, source_split string, question string, options array<string>, gold int, answer string, train string, source string")
    pairs = {(r.train_id, r.eval_id): False for r in O.find_overlaps(df, spark).collect()}
    for r in O.find_overlaps(df, spark).collect():
        pairs[r.train_id, r.eval_id] |= r.same
    about = {r[0]: (r[1], f"s{len(r[0]) % 2}") for r in rows if r[1] != O.TRAINING}
    want = {}
    for (_, e), same in pairs.items():
        w = want.setdefault(about[e], [0, 0, set()])
        w[0], w[1] = w[0] + 1, w[1] + same
        w[2].add(e)
    got = {(r.source_split, r.source): (r.pairs, r.exact_pairs, r.records) for r in O.overlap_report(df, spark).collect()}
    assert got == {k: (a, b, len(c)) for k, (a, b, c) in want.items()} and len(got) == 3
    assert O.overlap_report(df.limit(0), spark).collect() == []


def test_items_with_and_without_names_in_one_batch(spark):
    plain = "qual è il contrario di alto nella lingua di ogni giorno?"
    rows = [row("t", O.TRAINING), row("e", "proxy_dev", ALIKE["word"]), row("u", O.TRAINING, plain, ["basso", "lungo", "largo", "pieno"])]
    rows.append(row("f", "proxy_dev", "Secondo te, qual è il contrario di alto nella lingua poi di ogni giorno?", ["lungo", "pieno", "largo", "basso"], 3))
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA).coalesce(1)
    assert {(r.train_id, r.eval_id) for r in O.find_overlaps(df, spark).collect()} == {("t", "e"), ("u", "f")}
