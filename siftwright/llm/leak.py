"""Problem 8: passages of held-out items inside training documents.

The held-out passages are normalised and cut into word n-grams, and the set of
their hashes goes to every task. A task tokenises whole documents, looks all
token windows of a batch up at once, and counts hits per document, item and
diagonal band (the difference of both positions). Where a band holds enough
hits the words around it are aligned with the passage, which decides: edits,
insertions and slips break n-grams but not the chain of matching stretches.

Only the held-out side is sent to all tasks. Its size is checked: beyond
``BLOCK_WORDS`` words it is cut into blocks of items, each its own scan.
Nothing is gathered about the documents; there is no shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.pytext import strip_marks, unescape_all
from siftwright.session import read_table

#: Words of an n-gram; the scan and the alignment are written for three.
NGRAM = 3
#: A passage is aligned where one diagonal band, or two neighbouring ones, hold ``MIN_HITS`` hits of ``MIN_BITS``
#: together that lie ``MIN_SPREAD`` words apart, or ``SOME_HITS`` of ``MIN_BITS``, or ``MANY_HITS``. Eighteen words
#: with three changed keep seven hits.
MIN_HITS = 4
MIN_SPREAD = 9
SOME_HITS = 7
MANY_HITS = 12
MIN_BITS = 8.0
#: Width of a diagonal band in words: how far insertions may shift a passage.
BAND = 24
#: An alignment counts from this score (matched words less half of the words skipped) ...
SURE_SCORE = 18.0
#: ... or from this one if it spans ``MIN_SPAN`` words and holds a word that few items have.
FAIR_SCORE = 12.5
MIN_SPAN = 16
#: ... or if, with ends carried on over changed words, it spans ``MIN_STRETCH`` words, ``MIN_SHARE`` of them matched,
#: and matched words and bits together reach ``MIN_TOLD``. Bits count what the benchmark leaves open after two words of
#: a passage: none inside a phrase of many items, several where one phrase or name follows another.
MIN_STRETCH = 15
MIN_SHARE = 0.72
MIN_TOLD = 30.0
#: From this span and this share on, matched words need tell nothing.
LONG_STRETCH = 17
LONG_SHARE = 0.82
#: A word is particular to an item if no more items than this have it.
PARTICULAR_ITEMS = 2
#: Longest gap, in words, that an alignment bridges.
MAX_GAP = 7
#: Words of held-out text in one broadcast block (some 100 MB in a task's memory).
BLOCK_WORDS = 1_000_000
#: Characters of documents that a task handles at once.
CHUNK_CHARS = 2_000_000

_HYPHEN = re.compile(r"(\w)[-‐]\s*\n\s*(\w)")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
_WORD = re.compile(r"\w+")
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Folded words: escapes resolved, marks and invisible characters gone, line-end hyphens joined."""
    text = unescape_all(text)
    if not text.isascii():
        text = strip_marks(_INVISIBLE.sub("", text))
    if "-\n" in text or "‐" in text or "- " in text:
        text = _HYPHEN.sub(r"\1\2", text)
    return _WORD.findall(text.casefold().replace("_", " "))


class PassageIndex:
    """N-gram hashes of held-out passages and what the alignment needs."""

    def __init__(self, passages: list[tuple[int, str]]):
        self.items = [i for i, _ in passages]
        tokens = [words(p) for _, p in passages]
        self.vocabulary: dict[str, int] = {}
        self.ids = [[self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in row] for row in tokens]
        spread = Counter(t for row in self.ids for t in set(row))
        self.particular = []
        for row in self.ids:
            total, sums = 0, [0]
            for t in row:
                total += spread[t] <= PARTICULAR_ITEMS
                sums.append(total)
            self.particular.append(sums)
        spread2 = Counter(g for row in self.ids for g in set(zip(row, row[1:])))
        spread3 = Counter(g for row in self.ids for g in set(zip(row, row[1:], row[2:])))
        self.bits = []  # of every passage, bits of its first n three-word stretches
        for row in self.ids:
            total, sums = 0.0, [0.0]
            for g in zip(row, row[1:], row[2:]):
                total += math.log2(spread2[g[:2]] / spread3[g])
                sums.append(total)
            self.bits.append(sums)
        hashes, owner, place, weight = [], [], [], []
        for k, row in enumerate(self.ids):
            if len(row) >= NGRAM:
                h = ngram_hashes(np.asarray(row, dtype=np.uint64))
                hashes.append(h)
                owner.append(np.full(len(h), k, dtype=np.int64))
                place.append(np.arange(len(h), dtype=np.int64))
                weight.append(np.diff(np.asarray(self.bits[k])))
        h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner = (np.concatenate(owner) if hashes else np.empty(0, dtype=np.int64))[order]
        self.place = (np.concatenate(place) if hashes else np.empty(0, dtype=np.int64))[order]
        self.weight = (np.concatenate(weight) if hashes else np.empty(0))[order]
        self.unique, self.start, self.count = np.unique(h[order], return_index=True, return_counts=True)

    def align(self, k: int, hits: list[tuple[int, int]], ids: list[int]) -> tuple:
        """Best chain of matching stretches of passage k among ``hits (document position, passage position)``, sorted.

        ``ids`` are the words that positions of the document count in. Returns
        score, particular words in it, span in the passage, where it begins and
        ends in the document, words matched and bits of the stretches in it.
        The ends are carried on over single changed words; the score is that
        of the chain without them.
        """
        particular, bits, row = self.particular[k], self.bits[k], self.ids[k]
        segments: list[list[int]] = []
        running: dict[int, list[int]] = {}
        for d, p in hits:
            s = running.get(p - d)
            if s is not None and s[1] + s[2] - 2 == d:
                s[2] += 1
            else:
                running[p - d] = s = [p, d, 3]
                segments.append(s)
        segments.sort(key=lambda s: (s[1], s[0]))
        top = (0.0, 0, 0, 0, 0, 0, 0)
        chains: list[tuple] = []
        for j, (p, d, n) in enumerate(segments):
            own = particular[p + n] - particular[p]
            told = bits[p + n - 2] - bits[p]
            best = (n, own, p, d, n, told)
            for q in range(j - 1, -1, -1):
                p0, d0, n0 = segments[q]
                if d - d0 > 400:
                    break
                gap_p, gap_d = p - p0 - n0, d - d0 - n0
                if gap_p < -3 or gap_d < -3 or gap_p > MAX_GAP or gap_d > MAX_GAP:
                    continue
                b = chains[q]
                lap = max(0, -gap_p, -gap_d)
                score = b[0] + n - lap - 0.5 * max(gap_p, gap_d, 0)
                if score > best[0]:
                    same = sum(map(eq, row[p0 + n0 : p], ids[d0 + n0 : d])) if gap_p == gap_d > 1 else 0
                    best = (score, b[1] + own, b[2], b[3], b[4] + n - lap + same, b[5] + told)
            chains.append(best)
            if best[0] > top[0]:
                top = (best[0], best[1], p + n - best[2], best[3], d + n, best[4], best[5], best[2])
        if not top[0]:
            return top
        score, own, span, first, end, matched, told, p = top
        more, at_p, at_d = carried_on(row[p + span :], ids[end : end + 2 * (len(row) - p - span) + 2])
        less, to_p, to_d = carried_on(row[:p][::-1], ids[max(0, first - 2 * p - 2) : first][::-1])
        own += particular[p + span + at_p] - particular[p + span] + particular[p] - particular[p - to_p]
        return score, own, span + at_p + to_p, first - to_d, end + at_d, matched + more + less, told

    def scan(self, docs: list[list[str]]) -> list[tuple[int, int, float, int, int]]:
        """``(doc position, item position, score, first word, end word)`` of every leak, each place of it."""
        known = self.vocabulary.get
        ids: list[int] = []
        starts = []
        for row in docs:
            starts.append(len(ids))
            ids.extend([known(t, 0) for t in row])
            ids.append(0)
        if len(ids) < NGRAM or not len(self.unique):
            return []
        flat = np.asarray(ids, dtype=np.uint64)
        there = flat != 0
        at = np.flatnonzero(there[:-2] & there[1:-1] & there[2:])
        h = ngram_hashes(flat)[at]
        slot = np.searchsorted(self.unique, h)
        slot[slot == len(self.unique)] = 0
        hit = self.unique[slot] == h
        at, slot = at[hit], slot[hit]
        if not len(at):
            return []
        n = self.count[slot]
        begin = np.asarray(starts, dtype=np.int64)
        doc = np.searchsorted(begin, at, side="right") - 1
        entry = np.arange(n.sum()) + np.repeat(self.start[slot] - (np.cumsum(n) - n), n)
        pair = np.repeat(doc * len(self.items), n) + self.owner[entry]
        # what a band must hold its document and item must hold: most pairs of passing phrases go before any sort
        hits, told = np.bincount(pair), np.bincount(pair, weights=self.weight[entry])
        enough = (((told >= MIN_BITS - 1e-6) & (hits >= MIN_HITS)) | (hits >= MANY_HITS))[pair]
        which = np.repeat(np.arange(len(at)), n)[enough]
        entry, pair = entry[enough], pair[enough]
        if not len(entry):
            return []
        at, place, weight = at[which], self.place[entry], self.weight[entry]
        band = (at - begin[doc[which]] - place) // BAND + (1 << 20)
        key = (pair << 24) | band
        order = np.argsort(key, kind="stable")
        at, place, weight, pair = at[order], place[order], weight[order], pair[order]
        key = key[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        keys, hits = key[begins], np.diff(np.append(begins, len(key)))
        low, high = np.minimum.reduceat(place, begins), np.maximum.reduceat(place, begins)
        next_is = np.flatnonzero(keys[1:] == keys[:-1] + 1)
        both, least, most, told = hits.copy(), low.copy(), high.copy(), np.add.reduceat(weight, begins)
        told[next_is] += told[next_is + 1].copy()
        both[next_is] += hits[next_is + 1]
        least[next_is] = np.minimum(low[next_is], low[next_is + 1])
        most[next_is] = np.maximum(high[next_is], high[next_is + 1])
        candidates = (told >= MIN_BITS) & ((both >= SOME_HITS) | ((both >= MIN_HITS) & (most - least >= MIN_SPREAD)))
        candidates |= both >= MANY_HITS
        found: list[tuple] = []
        pairs = np.unique(keys[candidates] >> 24)
        for one, a, b in zip(pairs.tolist(), np.searchsorted(pair, pairs, side="left").tolist(), np.searchsorted(pair, pairs, side="right").tolist()):
            d, k = divmod(one, len(self.items))
            left = sorted(zip(at[a:b].tolist(), place[a:b].tolist()))
            while left:
                score, own, span, first, end, matched, bits = self.align(k, left, ids)
                if not is_leak(score, own, span, matched, bits):
                    break
                found.append((d, k, score, first - starts[d], end - starts[d]))
                left = [x for x in left if x[0] + NGRAM <= first or x[0] >= end]
        return found


def carried_on(row: list[int], window: list[int]) -> tuple[int, int, int]:
    """Words matched, and words of both sides passed, going on over a changed, added or left-out word before two equal ones."""
    n = p = d = 0
    while True:
        for gp, gd in ((0, 0), (1, 1), (0, 1), (1, 0)):
            a, b = row[p + gp : p + gp + 2], window[d + gd : d + gd + 2]
            if len(a) == 2 and a == b:
                n, p, d = n + 2, p + gp + 2, d + gd + 2
                break
        else:
            if p < len(row) and d < len(window) and row[p] == window[d] and n:
                n, p, d = n + 1, p + 1, d + 1
            return n, p, d


def is_leak(score: float, own: int, span: int, matched: int, bits: float) -> bool:
    if score >= SURE_SCORE or (score >= FAIR_SCORE and own and span >= MIN_SPAN):
        return True
    if span >= LONG_STRETCH and matched >= LONG_SHARE * span:
        return True
    return span >= MIN_STRETCH and matched >= MIN_SHARE * span and matched + bits >= MIN_TOLD


def ngram_hashes(ids: np.ndarray) -> np.ndarray:
    h = np.zeros(len(ids) - NGRAM + 1, dtype=np.uint64)
    for k in range(NGRAM):
        h = h * _RADIX + ids[k : k + len(h)]
    return h


LEAKS = "doc_id bigint, item_id bigint, score double, first_word int, end_word int"
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())])


def scanner(index):
    """A ``mapInArrow`` function over ``doc_id, text``; ``index`` is a broadcast ``PassageIndex``."""

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
        docs, texts, size = [], [], 0
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(d)
            texts.append(t)
            size += len(t)
            if size >= CHUNK_CHARS:
                yield docs, texts
                docs, texts, size = [], [], 0
        yield docs, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            rows = []
            for docs, texts in chunks(batch):
                rows += [(docs[d], known.items[k], s, a, b) for d, k, s, a, b in known.scan([words(t) for t in texts])]
            columns = zip(*rows) if rows else [[]] * len(_LEAKS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEAKS)], schema=_LEAKS)

    return run


def blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """Passages in lists of at most ``limit`` words (at least one item each), one at a time."""
    size = F.size(F.split("passage", r"\s+"))
    total, longest = items.agg(F.sum(size), F.max(size)).first()
    n = max(1, -(-(total + longest) // limit)) if total else 0
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        block = [(r[0], r[1]) for r in part.select("item_id", "passage").collect()]
        if block:
            yield block


def passages_of(benchmark: DataFrame) -> DataFrame:
    """``(item_id, passage)``: the item's text without its last line, the question."""
    passage = F.regexp_replace("text", r"\n[^\n]*$", "")
    return benchmark.where("item_id is not null and text is not null").select("item_id", passage.alias("passage"))


def find_leaks(documents: DataFrame, items: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per place where a document leaks an item: score and place, in words of the document.

    The index of a block of items is built once and broadcast; beyond
    ``BLOCK_WORDS`` words of items each block is a scan of its own.
    ``documents (doc_id, text)``, ``items (item_id, passage)``. Null texts leak
    nothing; passages of fewer words than an n-gram cannot be found; a repeated
    ``doc_id`` gives a row for each of its texts.
    """
    scanned = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
    found = None
    for block in blocks(items):
        part = scanned.mapInArrow(scanner(spark.sparkContext.broadcast(PassageIndex(block))), LEAKS)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], LEAKS) if found is None else found


_CHUNK = re.compile(r"(\s*)(\S+)")


def without_span(text: str, spans: list) -> str:
    """``text`` without the words of ``spans`` (``first_word, end_word``); lines left empty go.

    What is cut are the pieces between blanks that hold a word of a span. A
    line whose pieces cannot be told apart (escapes that hold blanks) goes whole.
    """
    spans = sorted((s["first_word"], s["end_word"]) for s in spans)
    firsts = [a for a, _ in spans]
    ends, most = [], 0
    for _, b in spans:
        most = max(most, b)
        ends.append(most)

    def inside(a: int, n: int) -> bool:
        """Whether one of the words a .. a + n - 1 lies in a span."""
        i = bisect_right(firsts, a + n - 1) - 1
        return n > 0 and i >= 0 and ends[i] > a

    kept, at = [], 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        n = len(words(line))
        joined = k + 1 < len(lines) and re.search(r"\w[-‐]\s*$", line) and re.match(r"\s*\w", lines[k + 1])
        if not inside(at, n):
            kept.append(line)
        else:
            pieces = _CHUNK.findall(line)
            counts = [len(words(w)) for _, w in pieces]
            if sum(counts) == n:
                out, here = "", at
                for (gap, w), c in zip(pieces, counts):
                    if not inside(here, c) and (c or not (inside(here - 1, 1) and inside(here, 1))):
                        out += gap + w
                    here += c
                if out.strip():
                    kept.append(out)
        at += n - bool(joined)
    return "\n".join(kept)


def remove_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the leaking documents, the words of leaked passages removed."""
    spans = leaks.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"))  # places of one document
    cut = F.udf(without_span, "string", useArrow=True)
    return documents.join(spans, "doc_id").select("doc_id", cut("text", "spans").alias("text"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents, passages_of(read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = _inputs(spark, sf_dir)
    return find_leaks(documents, items, spark).select("doc_id", "item_id").distinct()


def p8_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items that leak, with the number of documents and the best score."""
    documents, items = _inputs(spark, sf_dir)
    return find_leaks(documents, items, spark).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.max("score").alias("best_score")
    )


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = _inputs(spark, sf_dir)
    return remove_leaks(documents, find_leaks(documents, items, spark))
