"""Text functions. JVM-side expressions where built-ins suffice, Arrow-batched
Python for full Unicode normalisation and HTML references."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.functions import pytext

# Italian function words that carry no content, after normalisation.
STOPWORDS = (
    "a ad al alla alle allo ai agli anche che chi con da dal dalla dalle dallo dei degli del della delle dello di e ed fra gli ha hai hanno "
    "i il in io la le lo ma nei negli nel nella nelle nello non o per piu quale quali questa queste questi questo se seguente seguenti si sono "
    "su sul sulla tra un una uno vi"
).split()

# Cues of items on current affairs and on settled history, after normalisation.
CURRENT_CUES = (
    "oggi", "attualmente", "attuale", "attuali", "recentemente", "ultimo", "ultima", "in carica", "anno corrente", "al momento", "piu recente",
)
HISTORY_CUES = (
    "guerra mondiale", "risorgimento", "impero", "imperatore", "romano", "romana", "medioevo", "medievale", "rinascimento", "fascismo", "fascista",
    "nazismo", "nazista", "rivoluzione", "monarchia", "dinastia", "trattato", "armistizio", "antica grecia", "antica roma", "guerra fredda",
    "unificazione", "indipendenza", "liberazione", "secolo",
)

# Fragments of category names by domain, in the order in which they are tried.
DOMAIN_FRAGMENTS = (
    ("art_history", ("storia_dell_arte", "storia_delle_arti", "arte_e_", "_arte", "artist", "architett", "archeolog", "restauro", "beni_cultural", "muse")),
    ("literature", ("letteratur", "letterari", "poesia", "analisi_del_testo")),
    ("tourism", ("turis", "guide_turistic")),
    ("geography", ("geograf",)),
    ("history", ("storia", "storico")),
    ("civic_education", ("educazione_civica", "educazionecivica", "cittadin", "costituz", "unione_europe", "pubblica_amministrazione", "enti_locali",
                         "ordinamento", "politiche_comunitarie")),
    ("synonyms_and_antonyms", ("sinonim", "contrari", "capacita_verbale", "comprensione_verbale")),
    ("orthography", ("ortograf", "otograf")),
    ("syntax", ("sintass", "completamento_frasi")),
    ("morphology", ("morfolog", "coniug", "verbi")),
    ("lexicon", ("lessico", "vocabol", "significato", "lingua_italiana", "linguaitaliana", "italiano", "grammatica")),
)

_PLAIN = {"a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďḍ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ",
          "n": "ñńņň", "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž"}
_FROM = "".join(_PLAIN.values())
_TO = "".join(k * len(v) for k, v in _PLAIN.items())


def blank_as_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def norm_fold(c: Column) -> Column:
    """Accent-stripping normaliser for Latin text, JVM side: ``[a-z0-9]`` words, single spaces.

    Null gives the empty string. Text with HTML references or compatibility
    characters needs ``norm_fold_full``.
    """
    low = F.translate(F.regexp_replace(F.replace(F.lower(blank_as_empty(c)), F.lit("ß"), F.lit("ss")), r"\p{M}+", ""), _FROM, _TO)
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def norm_keep(c: Column) -> Column:
    """Accent-keeping normaliser, JVM side: straight quotes, single spaces, lower case."""
    quotes = F.translate(blank_as_empty(c), "‘’“”", "''\"\"")
    return F.lower(F.trim(F.regexp_replace(quotes, r"[\s\x{a0}]+", " ")))


def _series(f) -> Column:
    return F.pandas_udf(lambda s: pd.Series([f(x) for x in s], dtype="object"), T.StringType())


norm_fold_full = _series(pytext.norm_fold)
norm_keep_full = _series(pytext.norm_keep)
html_unescape = _series(lambda x: None if x is None else pytext.unescape(x))


def compact(c: Column) -> Column:
    """Form feeds removed, white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\f"), F.lit("")), r"\s+", " "))


def content_words(norm: Column, stopwords: Sequence[str] = tuple(STOPWORDS)) -> Column:
    """Words of a ``norm_fold`` text that are longer than one letter and no stopword, in order."""
    return F.filter(F.split(norm, " "), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))


def word_shingles(words: Column, width: int = 3) -> Column:
    """Distinct word shingles; texts with fewer words give their distinct words."""
    n = F.size(words) - (width - 1)
    # shifted copies zipped together: the word array is never indexed from inside a lambda, so the cost stays linear
    runs = F.slice(words, F.lit(1), F.greatest(n, F.lit(0)))
    for k in range(1, width):
        runs = F.zip_with(runs, F.slice(words, F.lit(k + 1), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(n >= 1, runs).otherwise(words))


def ascii_key(c: Column) -> Column:
    return F.replace(norm_fold(c), F.lit(" "), F.lit("_"))


def map_domain(category: Column, macro: Column, veto: str = "attual", rules=DOMAIN_FRAGMENTS) -> Column:
    """First domain, in rule order, with a fragment in the keyed category; a veto gives null."""
    value = F.concat_ws(" ", ascii_key(category), ascii_key(macro))
    out = F.when(value.contains(veto), F.lit(None).cast("string"))
    for domain, fragments in rules:
        hit = F.lit(False)
        for f in fragments:
            hit = hit | value.contains(f)
        out = out.when(hit, F.lit(domain))
    return out


def code_domain(code: Column, table: dict[str, str]) -> Column:
    """Domain of a one-letter code by a parameter table; unknown codes give null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.upper(code))


def years(norm: Column) -> Column:
    """Four-digit numbers 1000 to 2099 that stand alone in a normalised text."""
    return F.transform(F.filter(F.regexp_extract_all(norm, F.lit(r"(\d+)"), 1), lambda d: d.rlike("^(1[0-9]{3}|20[0-9]{2})$")), lambda d: d.cast("int"))


def _has_cue(norm: Column, cues: Iterable[str]) -> Column:
    return F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: norm.contains(c))


def is_current(norm: Column) -> Column:
    return F.exists(years(norm), lambda y: y > 2000) | _has_cue(norm, CURRENT_CUES)


def is_stable_history(norm: Column) -> Column:
    return ~is_current(norm) & (F.exists(years(norm), lambda y: (y >= 1000) & (y <= 2000)) | _has_cue(norm, HISTORY_CUES))


def clean_word(c: Column) -> Column:
    """A word of 3 to 22 Latin letters, else null."""
    w = F.trim(blank_as_empty(c))
    return F.when(w.rlike("^[A-Za-zÀ-ÖØ-öø-ÿ]+$") & F.length(w).between(3, 22), w)


def clean_gloss(c: Column, word: Column, prefixes: Sequence[str] = ("plurale di ", "femminile di ", "maschile di ", "forma di ")) -> Column:
    """A gloss of 18 to 220 characters that does not just name another form, else null."""
    g = F.regexp_replace(F.regexp_replace(blank_as_empty(c), r"\s+", " "), "^[ .;:]+|[ .;:]+$", "")
    low = norm_keep(g)
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | low.startswith(p)
    same = (norm_keep(word) == low) | (norm_keep(word) == F.element_at(F.split(low, r" \("), 1))
    return F.when(F.length(g).between(18, 220) & ~bad & ~same, g)


def spelling_variants(c: Column) -> Column:
    """Misspelled forms of a word: doubled consonants, swapped neighbours, dropped letters,
    digraph swaps and lost accents; distinct, without the word, in code point order."""
    inner = F.sequence(F.lit(2), F.length(c) - 1)
    part = lambda i, n: F.substr(c, i, n)
    upto = lambda i: F.substr(c, F.lit(1), i)
    doubled = F.transform(F.filter(inner, lambda i: ~F.lower(part(i, F.lit(1))).rlike("[aeiouàèéìòóù]")), lambda i: F.concat(upto(i), F.substr(c, i)))
    swapped = F.transform(inner, lambda i: F.concat(upto(i - 1), part(i + 1, F.lit(1)), part(i, F.lit(1)), F.substr(c, i + 2)))
    dropped = F.transform(inner, lambda i: F.concat(upto(i - 1), F.substr(c, i + 1)))
    digraphs = [F.when(F.lower(c).contains(a), F.regexp_replace(c, f"(?i)^(.*?){a}", f"$1{b}")).otherwise(c)
                for a, b in (("cq", "q"), ("q", "cq"), ("gl", "li"), ("li", "gl"), ("sce", "scie"), ("scie", "sce"))]
    plain = F.translate(c, "àèéìòóù", "aeeioou")
    every = F.concat(doubled, swapped, dropped, F.array(*digraphs, plain))
    return F.when(F.length(c) >= 3, F.array_sort(F.filter(F.array_distinct(every), lambda v: F.lower(v) != F.lower(c)))).otherwise(F.array().cast("array<string>"))


def similar_style(questions: Column, exemplars: Sequence[str], threshold: float = 0.86) -> Column:
    """Whether the longest-matching-blocks ratio to any exemplar reaches ``threshold``."""
    known = [pytext.norm_keep(e) for e in exemplars]

    def near(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            n = pytext.norm_keep(x)
            out.append(any(n == e or SequenceMatcher(None, n, e).ratio() >= threshold for e in known))
        return pd.Series(out, dtype="bool")

    return F.pandas_udf(near, T.BooleanType())(questions)


def pick_template(templates: Sequence[str], key: Column) -> Column:
    """One of the templates, by an integer key modulo their number."""
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (F.pmod(key, F.lit(len(templates))) + 1).cast("int"))


def mask_once(sentence: Column, word: Column, mask: str = "____") -> Column:
    """``sentence`` with its only whole-word match of ``word`` masked; null unless there is exactly one."""
    tokens = F.split(sentence, " ")
    at = F.filter(F.transform(tokens, lambda t, i: F.when(F.lower(F.regexp_replace(t, r"^\W+|\W+$", "")) == F.lower(word), i)), lambda i: i.isNotNull())
    masked = F.transform(tokens, lambda t, i: F.when(i == F.element_at(at, 1), F.replace(t, F.regexp_extract(t, r"(\w+)", 1), F.lit(mask))).otherwise(t))
    return F.when(F.size(at) == 1, F.array_join(masked, " "))


def display_lines(options: Column, order: Column) -> Column:
    """``A. option`` lines for options shown in ``order`` (0-based semantic index per slot)."""
    letters = F.array(*[F.lit(x) for x in "ABCDEFGH"])
    rows = F.transform(order, lambda s, d: F.concat(F.element_at(letters, d + 1), F.lit(". "), F.element_at(options, s + 1)))
    return F.array_join(rows, "\n")


def question_text(context: Column, question: Column) -> Column:
    return F.when(F.trim(blank_as_empty(context)) != "", F.concat(F.trim(context), F.lit("\n\n"), question)).otherwise(question)


def semantic_surfaces(question: Column, options: Column) -> tuple[Column, Column]:
    """The question alone, and with its trimmed options in code point order."""
    opts = F.array_join(F.array_sort(F.transform(options, lambda o: F.trim(o))), " || ")
    return question, F.concat(question, F.lit("\n\n"), opts)


def question_surfaces(*columns: Column, messages: Column | None = None) -> Column:
    """Non-blank question texts of a row: its own columns, then user messages (``role``, ``content``)."""
    own = F.filter(F.array(*columns), lambda x: x.isNotNull() & (F.trim(x) != ""))
    if messages is None:
        return own
    said = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])
    return F.concat(own, F.filter(said, lambda x: x.isNotNull() & (F.trim(x) != "")))


def option_value(raw: Column) -> Column:
    """Option text from a plain string, a ``{"value": ...}`` object or a one-key object, given as JSON."""
    parsed = F.from_json(raw, "map<string,string>")
    return F.coalesce(F.element_at(parsed, "value"), F.element_at(F.map_values(parsed), 1), raw)


def parse_answer(output: Column) -> dict[str, Column]:
    """First capital letter of a generated answer, and whether it is valid and exact."""
    letter = F.nullif(F.regexp_extract(F.coalesce(output, F.lit("")), "([A-Z])", 1), F.lit(""))
    return {
        "parsed": letter,
        "valid": F.coalesce(letter.rlike("^[A-D]$"), F.lit(False)),
        "exact": F.coalesce(F.trim(output).rlike("^[A-D]$"), F.lit(False)),
    }


def immediate_end(tokens: Column, answers: Column, end: Column) -> Column:
    """Whether generated ``tokens`` are an answer and the end mark right behind it."""
    return F.coalesce((F.size(tokens) >= 2) & F.array_contains(answers, F.get(tokens, F.lit(0))) & (F.get(tokens, F.lit(1)) == end), F.lit(False))


def footer_artifact(options: Column) -> Column:
    return F.exists(options, lambda o: F.trim(o).rlike(r"(?i)\bpagina(\s+\d+)?\s*$"))


def denied_path(path: Column, terms: Sequence[str]) -> Column:
    """The denied terms that a path holds, whatever the case; none for null."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms]))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def transcript(messages: Column) -> Column:
    """Contents of ``messages`` (``role``, ``content``) joined by line ends."""
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def turn_spans(messages: Column, role: str = "assistant") -> Column:
    """``(begin, end)`` of the turns of a role, in characters of the transcript."""
    begin = lambda i: F.aggregate(F.slice(messages, F.lit(1), i), F.lit(0), lambda n, m: n + F.length(m["content"]) + 1)
    spans = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), begin(i).alias("begin"), (begin(i) + F.length(m["content"])).alias("end")))
    return F.transform(F.filter(spans, lambda s: s["role"] == role), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
