"""Text normalisation that has no built-in equivalent, as plain Python.

These run inside Arrow-batched pandas UDFs; ``text.py`` wraps them and holds
the JVM-side forms.
"""

from __future__ import annotations

import html
import re
import unicodedata

_U_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_NON_FOLD = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_COMBINING = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_QUOTES = str.maketrans({"‘": "'", "’": "'", "‛": "'", "“": '"', "”": '"', "„": '"'})


def unescape(text: str, rounds: int = 8) -> str:
    """HTML character references resolved until nothing changes, ``rounds`` times at most."""
    for _ in range(rounds):
        if "&" not in text:
            return text
        after = html.unescape(text)
        if after == text:
            return text
        text = after
    return text


def unescape_all(text: str) -> str:
    """``unescape`` plus ``\\uXXXX`` escapes."""
    text = unescape(text)
    if "\\u" in text:
        text = unescape(_U_ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text))
    return text


def strip_marks(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    if text.isascii():
        return text
    return _COMBINING.sub("", unicodedata.normalize("NFKD", text))


def norm_fold(value: object) -> str:
    """Accent-stripping normaliser: letters a-z and digits, single spaces."""
    text = strip_marks(unescape(str(value or ""))).casefold().translate(_QUOTES)
    return _NON_FOLD.sub(" ", text).strip()


def norm_keep(value: object) -> str:
    """Accent-keeping normaliser: compatibility composition, quotes, spaces, case."""
    text = unicodedata.normalize("NFKC", str(value or "")).translate(_QUOTES)
    return _SPACE.sub(" ", text).strip().casefold()


def alnum_key(text: str | None) -> str:
    """Letters (with accents) and digits only, case folded, compatibility forms unified."""
    if not text:
        return ""
    text = unescape_all(text)
    if text.isascii():
        return "".join(filter(str.isalnum, text.casefold()))
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(filter(str.isalnum, text))


def osa_within(a: str, b: str, limit: int) -> bool:
    """Whether ``a`` turns into ``b`` by at most ``limit`` insertions, deletions,
    substitutions or swaps of neighbouring characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > limit:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) > 4 * limit + 4 and min(len(a), len(b)) == 0:
        return False
    before, row = None, list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        older, before, row = before, row, [x] + [0] * len(b)
        for y in range(1, len(b) + 1):
            cost = min(before[y] + 1, row[y - 1] + 1, before[y - 1] + (a[x - 1] != b[y - 1]))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                cost = min(cost, older[y - 2] + 1)
            row[y] = cost
        if min(row) > limit:
            return False
    return row[-1] <= limit
