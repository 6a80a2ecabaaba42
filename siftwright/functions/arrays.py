"""Permutations, option layouts and probability vectors as array expressions."""

from __future__ import annotations

import math
from itertools import permutations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwright.functions.keys import hash_int, order_key
from siftwright.functions.text import norm_keep

PERMUTATIONS = [list(p) for p in permutations(range(4))]
TINY = 1e-12


def permutation(number: Column) -> Column:
    """The permutation of four slots of that number, in lexicographic order; 0 is the identity."""
    table = F.array(*[F.array(*[F.lit(x) for x in p]) for p in PERMUTATIONS])
    return F.element_at(table, (F.pmod(number, F.lit(24)) + 1).cast("int"))


def view_orders(row_id: Column, views: int = 4, seed: str = "views") -> Column:
    """Distinct orders for the views of a row: the identity, then others in hash order."""
    others = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(23)), lambda k: F.struct(order_key(seed, row_id, k).alias("h"), k.alias("k"))))
    chosen = F.concat(F.array(F.lit(0)), F.transform(F.slice(others, 1, views - 1), lambda s: s["k"]))
    return F.transform(chosen, permutation)


def other_order(row_id: Column, step: Column, seed: str = "other") -> Column:
    """An order that is not the identity, by hash of row and step."""
    return permutation(hash_int(order_key(seed, row_id, step)) % 23 + 1)


def inverse(order: Column) -> Column:
    """For each semantic index the slot that shows it."""
    return F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda s: F.array_position(order, s.cast("int")).cast("int") - 1)


def to_semantic(shown: Column, order: Column) -> Column:
    """Values given per display slot, put back in semantic order."""
    return F.transform(inverse(order), lambda d: F.element_at(shown, d + 1))


def to_display(values: Column, order: Column) -> Column:
    return F.transform(order, lambda s: F.element_at(values, s + 1))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def exp_normalise(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / total(e))


def renormalise(values: Column) -> Column:
    return F.transform(values, lambda x: x / total(values))


def top1(values: Column) -> Column:
    """Index of the largest value; the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return exp_normalise(F.transform(logits, lambda x: x / F.lit(float(temperature))))


def kl(p: Column, q: Column) -> Column:
    safe = lambda x: F.log(F.greatest(x, F.lit(TINY)))
    return total(F.zip_with(p, q, lambda a, b: a * (safe(a) - safe(b))))


def js(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return (kl(p, m) + kl(q, m)) / 2


def mean_vector(rows: Column) -> Column:
    """Mean of equally long vectors in an array, summed to one."""
    sums = F.transform(F.element_at(rows, 1), lambda _, i: F.aggregate(rows, F.lit(0.0), lambda a, v: a + F.element_at(v, i + 1)))
    return renormalise(sums)


def drop_option(options: Column, protected: Column, key: Column) -> Column:
    """Kept semantic indices after dropping one option that is not protected, by key."""
    every = F.transform(options, lambda _, i: i)
    free = F.filter(every, lambda i: ~F.array_contains(protected, i))
    gone = F.element_at(free, (F.pmod(key, F.size(free)) + 1).cast("int"))
    return F.when(F.size(free) > 0, F.filter(every, lambda i: i != gone))


def reindexed(values: Column, indices: Column, added: float = 1e-8) -> Column:
    """Probabilities of the kept (or added: null) indices, summed to one."""
    return renormalise(F.transform(indices, lambda i: F.coalesce(F.element_at(values, i + 1), F.lit(added))))


def pinned_order(n: Column, answer: Column, slot: Column, salt: Column) -> Column:
    """An order of ``n`` options with ``answer`` in ``slot`` and the rest in hash order."""
    rest = F.filter(F.sequence(F.lit(0), n - 1), lambda i: i != answer)
    mixed = F.transform(F.array_sort(F.transform(rest, lambda i: F.struct(order_key(salt, i).alias("h"), i.alias("i")))), lambda s: s["i"])
    return F.concat(F.slice(mixed, F.lit(1), slot), F.array(answer), F.slice(mixed, slot + 1, n))


def distractors(pool: Column, answer: Column, key: Column, n: int = 3) -> Column:
    """``n`` pool entries in hash order, distinct in normal form and unlike the answer; null if too few."""
    keyed = F.transform(pool, lambda v: F.struct(order_key(key, norm_keep(v)).alias("h"), norm_keep(v).alias("n"), v.alias("v")))
    fit = F.array_sort(F.filter(keyed, lambda s: (s["n"] != norm_keep(answer)) & (s["n"] != "")))
    once = F.filter(fit, lambda s, i: (i == 0) | ~F.array_contains(F.transform(F.slice(fit, F.lit(1), i), lambda t: t["n"]), s["n"]))
    return F.when(F.size(once) >= n, F.transform(F.slice(once, 1, n), lambda s: s["v"]))


def twister_orders(ids: pd.Series, views: int = 4) -> pd.Series:
    """Parity form of the view orders with Python's Mersenne twister (``pandas_udf`` body)."""
    import hashlib
    import random

    out = []
    for i in ids:
        orders, attempt = [[0, 1, 2, 3]], 0
        while len(orders) < views:
            rng = random.Random(int.from_bytes(hashlib.sha256(f"{i}:{attempt}".encode()).digest()[:8], "big"))
            o = [0, 1, 2, 3]
            rng.shuffle(o)
            if o not in orders:
                orders.append(o)
            attempt += 1
        out.append(orders)
    return pd.Series(out)


def learning_rate(progress: Column, top: float, low: float, warm: float = 0.05, floor: float = 0.01) -> Column:
    """Linear warm-up to ``top``, then a cosine down to ``low``; ``progress`` runs from 0 to 1."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))
    cosine = (p - warm) / (1 - warm)
    return F.when(p < warm, F.lit(top) * F.greatest(F.lit(floor), p / warm)).otherwise(low + (top - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * cosine)))


def ramp(step: Column, start: int, end: int, top: float) -> Column:
    return F.when(step <= start, 0.0).when(step >= end, top).otherwise(F.lit(top) * (step - start) / float(end - start))


def parse_features(feats: Column) -> Column:
    """``Key=Value|Key=Value`` as a map; ``_``, blank and null are empty."""
    pairs = F.filter(F.split(F.coalesce(feats, F.lit("")), r"\|"), lambda x: x.contains("="))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.element_at(F.split(x, "=", 2), 1), F.element_at(F.split(x, "=", 2), 2))))


def format_features(upos: Column, feats: Column, keys=("Mood", "Tense", "VerbForm", "Person", "Gender", "Number", "Degree")) -> Column:
    parts = F.concat(F.array(F.lower(upos)), F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.lower(F.element_at(feats, k))))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())), ", ")


def mutate_features(feats: Column, alternatives: dict[str, tuple[str, ...]]) -> Column:
    """Maps that differ from ``feats`` in the value of one present key."""
    pairs = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, vs in alternatives.items() for v in vs]
    fit = F.filter(F.array(*pairs), lambda p: F.map_contains_key(feats, p["k"]) & (F.element_at(feats, p["k"]) != p["v"]))
    return F.transform(fit, lambda p: F.transform_values(feats, lambda k, v: F.when(k == p["k"], p["v"]).otherwise(v)))
