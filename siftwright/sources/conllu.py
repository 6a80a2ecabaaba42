"""CoNLL-U treebanks as one row per sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.arrays import parse_features


def parse_blocks(blocks: DataFrame, column: str = "value") -> DataFrame:
    """``(sent_id, text, tokens)`` from sentence blocks.

    Comment lines ``# key = value`` are metadata; of the ten tab-separated
    columns ``id form lemma upos feats head deprel`` are kept, for plain integer
    ids only; a relation is cut at its first colon. A missing text is the joined
    forms, a missing id a hash of the text. Blocks without tokens are left out.
    """
    # generators over one-element arrays: what they hold is made once, not again for every use
    blocks = blocks.select(F.explode(F.array(F.split(F.col(column), r"\r?\n"))).alias("lines"))
    lines = F.col("lines")
    fields = F.transform(lines, lambda x: F.split(x, "\t"))
    rows = F.filter(fields, lambda f: (F.size(f) == 10) & F.element_at(f, 1).rlike("^[0-9]+$"))
    tokens = F.transform(rows, lambda f: F.struct(
        F.element_at(f, 1).cast("int").alias("id"), F.element_at(f, 2).alias("form"), F.element_at(f, 3).alias("lemma"),
        F.element_at(f, 4).alias("upos"), parse_features(F.element_at(f, 6)).alias("feats"),
        F.coalesce(F.element_at(f, 7).try_cast("int"), F.lit(0)).alias("head"), F.element_at(F.split(F.element_at(f, 8), ":"), 1).alias("deprel"),
    ))

    def meta(key: str):
        hit = F.filter(lines, lambda x: x.startswith(f"# {key} = "))
        return F.when(F.size(hit) > 0, F.substr(F.element_at(hit, -1), F.lit(len(key) + 6)))

    made = F.struct(tokens.alias("tokens"), meta("text").alias("t"), meta("sent_id").alias("s"))
    parsed = blocks.select(F.explode(F.array(made)).alias("x")).select("x.*").where(F.size("tokens") > 0)
    text = F.coalesce(F.nullif("t", F.lit("")), F.array_join(F.transform("tokens", lambda x: x["form"]), " "))
    return parsed.select(
        F.coalesce(F.nullif("s", F.lit("")), F.concat(F.lit("anonymous:"), F.substring(F.sha2(text, 256), 1, 16))).alias("sent_id"),
        text.alias("text"), "tokens",
    )


def read_conllu(spark: SparkSession, *paths: str) -> DataFrame:
    """Files are split at blank lines by the reader, so a large file is read in parallel."""
    return parse_blocks(spark.read.option("lineSep", "\n\n").text(list(paths)))
