"""Readers and writers: JSON lines, Parquet, CoNLL-U, zipped documents, matrices."""
