"""Spark-first engine for curating question and text corpora.

Every operator is a ``DataFrame -> DataFrame`` function (or a ``Column``
expression); no state lives outside DataFrames and no result depends on how
the input is partitioned.
"""
