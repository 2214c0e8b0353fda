"""Operators for large text corpora (deduplication, decontamination, scoring, tokens)."""
