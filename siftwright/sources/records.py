"""Record tables printed in fixed columns, also as PDF members of zip archives.

A record starts with a code, two capitals and five digits. Its first line sets
the columns: the question, four options marked ``a)`` to ``d)``, and the letter
of the right one at the line's end; later lines continue each column.
"""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.pytext import norm_fold

# How records, options and the right letter are printed.
CODE = re.compile(r"^([A-Z]{2}\d{5})\s")
MARK = re.compile(r"(?<!\w)([a-d])\)\s*")
LETTER = re.compile(r"\s{2,}([a-dA-D])\s*$")
HEADER = "vietata la pubblicazione"

RECORD = "member string, record_code string, question string, options array<string>, gold int, gold_letter string, gold_text string, reason string"


def _columns(line: str) -> list[int] | None:
    """Starts of the four options and of the letter, or None."""
    right = LETTER.search(line)
    marks = [(m.group(1), m.start()) for m in MARK.finditer(line)]
    for k in range(len(marks) - 3):
        four = marks[k : k + 4]
        if right and "".join(c for c, _ in four) == "abcd" and four[3][1] < right.start(1) and four[0][1] > 7:
            return [p for _, p in four] + [right.start(1)]
    return None


def parse_record(code: str, lines: list[str]) -> dict:
    """One record, or the reason why it cannot be read."""
    row = dict(record_code=code, question=None, options=None, gold=None, gold_letter=None, gold_text=None, reason="accepted")
    at = _columns(lines[0])
    if at is None:
        return row | {"reason": "columns"}
    cells: list[list[str]] = [[] for _ in range(5)]
    edges = [0, *at]
    for k, line in enumerate(lines):
        if HEADER in line.casefold():
            continue
        line = line.replace("\f", " ")
        if k == 0:
            line = " " * len(code) + line[len(code):]
        for c in range(5):
            piece = " ".join(line[edges[c] : edges[c + 1]].split())
            if k == 0 and c:
                piece = MARK.sub("", piece, count=1)
            if piece:
                cells[c].append(piece)
    question, *options = (" ".join(c).strip() for c in cells)
    letter = lines[0].rstrip()[-1].upper()
    if not question:
        return row | {"reason": "question"}
    if not all(options):
        return row | {"reason": "empty_option"}
    if len({norm_fold(o) for o in options}) < 4:
        return row | {"reason": "repeated_option"}
    gold = "ABCD".index(letter)
    return row | {"question": question, "options": options, "gold": gold, "gold_letter": letter, "gold_text": options[gold]}


def parse_table(text: str) -> Iterator[dict]:
    """Records of one printed table, in order, rejected ones with their reason."""
    code, lines = None, []
    for line in text.replace("\f", "\n").split("\n"):
        m = CODE.match(line)
        if m:
            if code:
                yield parse_record(code, lines)
            code, lines = m.group(1), [line]
        elif code and line.strip():
            lines.append(line)
    if code:
        yield parse_record(code, lines)


def parse_tables(texts: DataFrame) -> DataFrame:
    """Records of ``texts (member, text)``, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for pdf in batches:
            rows = [{"member": m, **r} for m, t in zip(pdf["member"], pdf["text"]) if t for r in parse_table(t)]
            yield pd.DataFrame(rows, columns=columns).astype({"gold": "Int32"})

    return texts.select("member", "text").mapInPandas(run, RECORD)


def pdf_text(content: bytes) -> str:
    """Text of a PDF in its layout, by the ``pdftotext`` program."""
    tool = shutil.which("pdftotext")
    if tool is None:
        raise RuntimeError("pdftotext is not installed")
    return subprocess.run([tool, "-layout", "-", "-"], input=content, check=True, capture_output=True).stdout.decode("utf-8", "replace")


def read_archives(spark: SparkSession, path: str, include: str = r"\.(pdf|txt)$", exclude: str | None = None) -> DataFrame:
    """``(archive, archive_sha256, member, member_sha256, text)`` of zip archives, PDF members converted."""
    import hashlib

    wanted, refused = re.compile(include, re.I), re.compile(exclude, re.I) if exclude else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, digest, content in zip(pdf["path"], pdf["digest"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(z.namelist()):
                        if wanted.search(m) and not (refused and refused.search(m)):
                            data = z.read(m)
                            text = pdf_text(data) if m.lower().endswith(".pdf") else data.decode("utf-8", "replace")
                            rows.append((name, digest, m, hashlib.sha256(data).hexdigest(), text))
            yield pd.DataFrame(rows, columns=["archive", "archive_sha256", "member", "member_sha256", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"), "content")
    return files.mapInPandas(run, "archive string, archive_sha256 string, member string, member_sha256 string, text string")
