"""Problem 1: the same or nearly the same item in training and evaluation splits.

Records are canonicalised (case, punctuation, white space, escapes, accents of
the question, order of the options); records of one canonical form are a class,
named by its hash. Classes with members on both sides are exact overlaps.
Everything below works on classes; ids are joined to them at the end, and the
report multiplies their counts without expanding anything.

Near matches need hashes that survive small edits. Two items can only match if
right answer and numbers agree and if every name and quoted word of one stands
in the other. So a record with such a word sends a probe, the hash of its right
answer, numbers and longest name or quoted word, and meets the other side's
records that hold that word under the same answer and numbers. Of two records
without any, a number of words may differ that is bounded by ``MAX_EDITS`` and
``MAX_INTRO``, so they share one of their ``ANCHORS`` words of lowest hash, and
one wrong option at least; their keys are made of these. No pair that the
comparison accepts is missed, and no statistic of the table enters into it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.functions.pytext import alnum_key, osa_within, strip_marks, unescape_all
from siftwright.session import Scratch, read_table

TRAINING = "pilot_train"
#: Words changed, dropped or added that two copies may differ by, on either side.
MAX_EDITS = 5
#: Words of an introductory phrase, which are free.
MAX_INTRO = 8
#: So many words of lowest hash of two questions have one in common if no more words than that differ.
ANCHORS = MAX_EDITS + MAX_INTRO + 1
#: Small words that are ordinary also where the case of a text shows nothing: fixed values.
SMALL_WORDS = frozenset(
    "a ad al alla allo ai agli alle anche ancora allora che chi con come cosa cui da dal dalla dallo dai dagli dalle del della dello dei degli delle "
    "di dove dunque e ed era fu gia il i gli in infatti inoltre invece l la le lo ma mai ne nel nella nello nei negli nelle non o oggi ossia per pero "
    "piu poi proprio pure qual quale quali quando quanto quel quella quello quindi se sempre si sia solo sono su sul sulla suo sua tra fra tutto un una uno "
    "about after all also an and are as at be but by for from has have how however in is it its more not now of on or so some such than that the their then "
    "there these this thus to too was were what when where which who why will with "
    "au aussi avec ce cette dans de des du elle en encore est et il la le les mais ou par pas plus pour qui que sur un une "
    "aber als am an auch auf aus bei das dem den der des die doch ein eine einem einen einer es fur hat im ist mit nach nicht noch nun oder sich sie so "
    "und von war was wer wie wo zu zum zur "
    "al como con cual de del donde el en entonces es esta este la las lo los mas muy no o para pero por que quien se si sin su sus tambien un una y ya".split()
)

_INVISIBLE = re.compile("[­​-‍⁠﻿]")
option_key = lru_cache(maxsize=1 << 16)(alnum_key)
#: Words of a token, folded.
folded = lru_cache(maxsize=1 << 17)(lambda token: tuple(_TOKEN.findall(strip_marks(token).casefold())))
_TOKEN = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"[«“\"„‹]\s*([^\W_]+)\s*[»”\"“›]")
_INTRO = re.compile(r"^\W*(?:\([^()]{1,60}\)|\[[^\[\]]{1,60}\]|[^.:!?]{1,60}[.:!])\s+(?=\S)")

_LABEL = r"(?:domanda|quesito|esercizio|item|question|frage|pregunta)"
#: A number or letter that only counts items: ``12)``, ``(12)``, ``12.``, ``12 -``, ``b)``, ``IV)``, ``n. 12:``, ``Domanda 12``.
#: Not a capital with a stop before a name (an initial), nor a number that belongs to the sentence (``1440 - ``, ``3.5``, a German date).
_ENUMERATOR = re.compile(
    rf"^[\W_]*(?:{_LABEL}\s*(?:n\s*[.°º]?\s*)?\d{{1,4}}(?!\w)\s*[).\]:–—-]*|n(?:r|um)?\s*[.°º]\s*\d{{1,4}}\s*[).\]:–—-]+"
    r"|[(\[](?:\d{1,3}|[a-z])[)\]]|(?:\d{1,3}|[a-z]|[ivxl]{2,5})\s*\)|\d{1,3}\s*[:–—-](?=\s*[^\W\d_]{2})"
    r"|\d{1,3}\s*\.(?!\s*(?:januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jahrhundert)\b)"
    r"|[a-z]\s+[–—-](?=\s)|(?-i:[a-z])\.(?=\s)"
    r"|[a-z]\.(?=\s+(?:chi|che|cosa|come|dove|quando|perché|qual[ei]?|quant[oaie]|indica(?:re)?|individua(?:re)?|scegli|completa|who|what|which|when|where|why|how)\b))"
    r"\s*(?=\W*[^\W\d_]|[(\[]?\d{1,3}\s*[).\]])",
    re.IGNORECASE,
)


def clean(text: str) -> str:
    return _INVISIBLE.sub("", unescape_all(text))


def without_enumerator(text: str) -> str:
    """``text`` without the item numbers it begins with, if a question is left."""
    while (m := _ENUMERATOR.match(text)) and len(_TOKEN.findall(text[m.end():])) > 1:
        text = text[m.end():]
    return text


def without_intro(text: str) -> str:
    """``text`` without leading item numbers, bracketed phrases and short leading sentences, if a question is left."""
    text = without_enumerator(text)
    for _ in range(3):
        m = _INTRO.match(text)
        if not m or len(_TOKEN.findall(text[m.end():])) < 4 or any(ch.isdigit() or ch in "«»\"" for ch in m[0]):
            break
        if len(_TOKEN.findall(m[0])) > (4 if m[0].rstrip().endswith(":") else 7):
            break
        text = without_enumerator(text[m.end():])
    return text


def tokenise(question: str) -> tuple[list[str], str]:
    """Folded words and a class for each, as one character:

    ``d`` holds a digit, ``q`` a single word in quotation marks, ``n`` written
    as a name, ``o`` written as an ordinary word, ``u`` unknown, where the text
    is all lower case, all capitals or all title case and shows nothing (``f``
    for its first word, which a rewording changes most often).
    """
    raw = without_intro(clean(question))
    words, kinds = [], []
    quoted = {strip_marks(w).casefold() for w in _QUOTED.findall(raw)}
    tokens = _TOKEN.findall(raw)
    letters = [t for t in tokens if t.isalpha()]
    capital = sum(t[0].isupper() for t in letters)
    plain = capital <= max(1, 0.75 * len(letters)) and any(t[0].islower() and len(t) > 2 for t in letters) and capital > 0
    for k, t in enumerate(tokens):
        for part in folded(t):
            words.append(part)
            if not part.isalpha() and any(map(str.isdigit, part)):
                kinds.append("d")
            elif part in quoted:
                kinds.append("q")
            elif not plain:
                kinds.append("u" if k else "f")
            elif k == 0:  # capital in any case: a name if a name goes on behind it
                kinds.append("n" if len(tokens) > 1 and tokens[1][0].isupper() else "o")
            else:
                kinds.append("n" if t[0].isupper() else "o")
    return words, "".join(kinds)


ITEM = T.StructType([
    T.StructField("words", T.StringType()), T.StructField("kinds", T.StringType()),
    T.StructField("right", T.StringType()), T.StructField("wrong", T.StringType()),
    T.StructField("probe", T.LongType()), T.StructField("held", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType())),
])


def readings(words: list[str], kinds: str) -> dict[str, str]:
    """Class of each word; of a word that stands twice, the reading that shows an ordinary word counts."""
    return {w: k for w, k in sorted(zip(words, kinds), key=lambda x: "nufoqd".index(x[1]))}


def join_keys(words: list[str], kinds: str, right: str, wrong: list[str]) -> tuple[int | None, list[int], list[int] | None]:
    """``(probe, held, keys)`` of an item: its probe, if it has a name or quoted word, what other
    probes find it by, and, if it has no probe, the keys by which two such items meet."""
    def h(*parts: str) -> int:
        return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)

    base = right + "\x1e" + " ".join(sorted(w for w, k in zip(words, kinds) if k == "d"))
    kind = readings(words, kinds)
    rest = [w for w, k in kind.items() if k != "d"]
    held = [h(base, w) for w in rest]
    marks = [w for w in rest if kind[w] in "nq"]
    if marks:
        return h(base, max(marks, key=lambda w: (len(w), w))), held, None
    anchors = sorted(rest, key=lambda w: (xxhash.xxh64_intdigest(w), w))[:ANCHORS] or [""]
    return None, held, [h(base, o, w) for o in dict.fromkeys(wrong) for w in anchors]


def canonical_items(question: pd.Series, options: pd.Series, gold: pd.Series, answer: pd.Series) -> pd.DataFrame:
    """Canonical form and join keys of items of four options with a known right answer; null for others.

    The right answer is the option that ``gold`` counts to, or, where ``gold``
    is missing or out of range, the option that ``answer`` spells.
    """
    out = []
    for q, o, g, a in zip(question, options, gold, answer):
        item = (None,) * 7
        if q is not None and o is not None and len(o) == 4:
            words, kinds = tokenise(q)
            keys = [option_key(x or "") for x in o]
            at = int(g) if g is not None and g == g and 0 <= g < 4 else None
            if at is None and a:
                key = option_key(a)
                at = keys.index(key) if key and keys.count(key) == 1 else None
            if words and at is not None and keys[at]:
                wrong = sorted(keys[:at] + keys[at + 1:])
                item = (" ".join(words), kinds, keys[at], "\x1f".join(wrong), *join_keys(words, kinds, keys[at], wrong))
        out.append(item)
    columns = ["words", "kinds", "right", "wrong", "probe", "held", "keys"]
    # 64-bit values beside nulls: never by way of floats
    return pd.DataFrame({c: pd.array([x[k] for x in out], dtype="Int64") if c == "probe" else pd.Series([x[k] for x in out], dtype=object) for k, c in enumerate(columns)})


def slip(a: str, b: str) -> bool:
    """Whether two option texts are one text with a slip of the pen on either side."""
    if a == b:
        return True
    n = min(len(a), len(b))
    if n < 4 or any(ch.isdigit() for ch in a + b):
        return False
    return osa_within(a, b, 1) or (n >= 8 and osa_within(a, b, 2))


def same_options(a: list[str], b: list[str]) -> bool:
    """Equal but for a slip in one wrong option on either side."""
    ca, cb = Counter(a), Counter(b)
    x, y = sorted((ca - cb).elements()), sorted((cb - ca).elements())
    if len(x) > 2:
        return False
    return all(map(slip, x, y)) or (len(x) == 2 and slip(x[0], y[1]) and slip(x[1], y[0]))


def same_question(wa: list[str], ka: str, wb: list[str], kb: str) -> bool:
    """Equal but for an introduction and a few ordinary words.

    A word that only one side has must be ordinary: written in lower case amid
    text that has capitals, or a small word, or, in a text whose case shows
    nothing, in the place of an ordinary word of the other side. Numbers, quoted words
    and names must all agree.
    """
    if wa == wb:
        return True
    ca, cb = Counter(wa), Counter(wb)
    only_a, only_b = ca - cb, cb - ca
    if not only_a and not only_b:
        return True  # the same words in another order
    kind_a, kind_b = readings(wa, ka), readings(wb, kb)

    def ordinary(w: str, kind: str) -> bool:
        return kind in "of" or (kind == "u" and w in SMALL_WORDS)

    def intro(words: list[str], only: Counter, other: Counter) -> int:
        n = 0
        while n < min(len(words), MAX_INTRO) and words[n] in only and words[n] not in other:
            n += 1
        return n

    free_a, free_b = intro(wa, only_a, cb), intro(wb, only_b, ca)
    if max(sum(only_a.values()) - (free_a if free_a > 1 else 0), sum(only_b.values()) - (free_b if free_b > 1 else 0)) > MAX_EDITS:
        return False
    if len(wa) < 3 or len(wb) < 3:
        return False
    # where one side shows nothing, a word may stand for an ordinary word of the other side
    for only, kind, other, other_kind in ((only_a, kind_a, only_b, kind_b), (only_b, kind_b, only_a, kind_a)):
        strange = [w for w in only if not ordinary(w, kind[w])]
        if any(kind[w] in "dqn" for w in strange) or len(strange) > sum(ordinary(w, other_kind[w]) for w in other):
            return False
    return 2 * sum((ca & cb).values()) >= max(len(wa), len(wb))


_PAIR = ["e1", "e2", "t1", "t2"]


def link_classes(items: DataFrame, spark: SparkSession, training: str = TRAINING) -> tuple[DataFrame, DataFrame]:
    """``linked (e1, e2, t1, t2, same)`` and ``members (id, train, h1, h2)``.

    ``linked`` has each evaluation class with each training class that asks the
    same, ``same`` telling whether they are one canonical form; the two hashes
    name a class. Parameters and cases as in ``find_overlaps``.
    """
    scratch = Scratch(spark, "overlap")
    canon = F.pandas_udf(canonical_items, ITEM)
    rows = items.where("id is not null and source_split is not null and question is not null and size(options) = 4").select(
        "id", (F.col("source_split") == training).alias("train"), canon("question", "options", "gold", "answer").alias("c")
    ).where("c.words is not null")
    text = F.concat_ws("\x1e", "c.words", "c.right", "c.wrong")
    records = scratch.cut(rows.select("id", "train", F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), "c.*"))
    side = records.groupBy("h1", "h2").agg(F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("e"))
    equal = side.where("t and e").select(
        F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.lit(True).alias("same")
    )

    def keyed(rows: DataFrame, key: str, to: str) -> DataFrame:
        """Distinct keys of classes: copies count once before any join."""
        value = F.explode(key) if key != "probe" else F.col(key)
        return rows.select(value.alias("key"), F.col("h1").alias(to + "1"), F.col("h2").alias(to + "2")).distinct()

    evals, trains = records.where("not train"), records.where("train")
    met = keyed(evals.where("probe is not null"), "probe", "e").join(keyed(trains, "held", "t"), "key")
    met = met.unionByName(keyed(evals.where("probe is null"), "held", "e").join(keyed(trains.where("probe is not null"), "probe", "t"), "key"))
    met = met.unionByName(keyed(evals.where("probe is null"), "keys", "e").join(keyed(trains.where("probe is null"), "keys", "t"), "key"))
    met = scratch.cut(met.where("e1 <> t1 or e2 <> t2").select(*_PAIR).distinct())

    def with_body(pairs: DataFrame, of: str) -> DataFrame:
        body = ["words", "kinds", "right", "wrong"]
        ends = pairs.select(F.col(of + "1").alias("h1"), F.col(of + "2").alias("h2")).distinct()
        bodies = records.join(ends, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(F.struct(*body)).alias("b"))
        bodies = bodies.select(F.col("h1").alias(of + "1"), F.col("h2").alias(of + "2"), *[F.col("b")[c].alias(f"{of}_{c}") for c in body])
        return scratch.cut(pairs.join(bodies, [of + "1", of + "2"]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {f: batch.column(f).to_pylist() for f in batch.schema.names}
            keep = [
                same_options(ew.split("\x1f"), tw.split("\x1f")) and same_question(a.split(" "), ka, b.split(" "), kb)
                for ew, tw, a, ka, b, kb in zip(col["e_wrong"], col["t_wrong"], col["e_words"], col["e_kinds"], col["t_words"], col["t_kinds"])
            ]
            yield batch.select(_PAIR).filter(pa.array(keep, pa.bool_()))

    near = with_body(with_body(met, "e"), "t").where("e_right = t_right")
    near = near.mapInArrow(verify, "e1 bigint, e2 int, t1 bigint, t2 int").withColumn("same", F.lit(False))
    linked = scratch.cut(near.select(*_PAIR, "same").unionByName(equal))
    return linked, records.select("id", "train", "h1", "h2").distinct()


def _side(members: DataFrame, train: bool, *extra: str) -> DataFrame:
    """Members of one side under the names of that side in ``linked``."""
    to, name = ("t", "train_id") if train else ("e", "eval_id")
    rows = members.where("train" if train else "not train")
    return rows.select(F.col("h1").alias(to + "1"), F.col("h2").alias(to + "2"), F.col("id").alias(name), *extra)


def find_overlaps(items: DataFrame, spark: SparkSession, training: str = TRAINING) -> DataFrame:
    """``(train_id, eval_id, same)`` for every training and evaluation record that ask the same.

    ``items`` needs ``id, source_split, question, options, gold`` and
    ``answer`` (may be null). ``same`` tells whether the canonical records are
    equal. Rows with a null id or split, blank questions, other than four
    options or no known right answer are no case. An id delivered repeatedly
    counts once.
    """
    linked, members = link_classes(items, spark, training)
    pairs = linked.join(_side(members, False), ["e1", "e2"]).join(_side(members, True), ["t1", "t2"])
    return pairs.where("eval_id <> train_id").select("train_id", "eval_id", "same")


def overlap_report(items: DataFrame, spark: SparkSession, training: str = TRAINING) -> DataFrame:
    """Per evaluation split and source: distinct pairs, those of equal records, and evaluation records concerned.

    Pairs of classes are multiplied by the counts of their members and never
    expanded. Only ids that stand in several classes, or on both sides, could
    count a pair twice; theirs are put together by id.
    """
    scratch = Scratch(spark, "overlap-report")
    linked, members = link_classes(items, spark, training)
    about = items.where("id is not null and source_split is not null").withColumn("_t", F.col("source_split") == training)
    about = about.groupBy("id").agg(
        F.min(F.when(~F.col("_t"), F.struct("source_split", "source"))).alias("r"), F.countDistinct("_t").alias("sides")
    )
    per_id = members.groupBy("id").agg(F.count(F.lit(1)).alias("places")).join(about, "id")
    members = scratch.cut(members.join(per_id, "id").select("id", "train", "h1", "h2", "r.*", (F.col("places") > 1).alias("several")))
    e_all, t_all = _side(members, False, "source_split", "source", "several"), _side(members, True, "several")
    e_n = e_all.where("not several").groupBy("e1", "e2", "source_split", "source").agg(F.count(F.lit(1)).alias("n_e"))
    t_n = t_all.where("not several").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_t"))
    by = ["source_split", "source"]
    counted = linked.join(e_n, ["e1", "e2"]).join(t_n, ["t1", "t2"]).groupBy(*by).agg(
        F.sum(F.col("n_e") * F.col("n_t")).alias("pairs"), F.sum(F.when(F.col("same"), F.col("n_e") * F.col("n_t")).otherwise(0)).alias("exact_pairs")
    )
    wide = linked.join(e_all.where("several"), ["e1", "e2"]).join(t_all.drop("several"), ["t1", "t2"]).unionByName(
        linked.join(t_all.where("several"), ["t1", "t2"]).join(e_all.where("not several"), ["e1", "e2"]).drop("several").withColumn("several", F.lit(True))
        .select("t1", "t2", "e1", "e2", "same", "eval_id", *by, "several", "train_id")
    )
    wide = wide.where("eval_id <> train_id").groupBy("eval_id", "train_id", *by).agg(F.bool_or("same").alias("same"))
    wide = scratch.cut(wide)
    wide_n = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("same").alias("exact_pairs"))
    # evaluation records: those with one place by the counts of their class, the others by id
    trained = linked.join(t_all.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").select("e1", "e2").distinct()
    one = trained.join(e_n, ["e1", "e2"]).groupBy(*by).agg(F.sum("n_e").alias("records"))
    more = wide.join(e_all.where("several").select("eval_id").distinct(), "eval_id", "left_semi")
    more = more.groupBy(*by).agg(F.countDistinct("eval_id").alias("records"))
    zero = F.lit(0).cast("bigint")
    parts = counted.select(*by, "pairs", "exact_pairs", zero.alias("records")).unionByName(wide_n.select(*by, "pairs", "exact_pairs", zero.alias("records")))
    for part in (one, more):
        parts = parts.unionByName(part.select(*by, zero.alias("pairs"), zero.alias("exact_pairs"), "records"))
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pairs", "exact_pairs", "records")])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "zagreus_final_instrument")
    return rows.select("id", "source", "source_split", "question", "options", "gold", F.col("metadata.answer").alias("answer"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(_items(spark, sf_dir), spark)
    return found.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p1_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source: pairs, exact pairs and records concerned."""
    return overlap_report(_items(spark, sf_dir), spark)
