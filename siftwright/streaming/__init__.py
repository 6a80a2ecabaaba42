"""Structured Streaming forms of resumable labelling."""
