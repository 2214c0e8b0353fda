"""Micro-batch ingestion driven by Structured Streaming file arrival."""
