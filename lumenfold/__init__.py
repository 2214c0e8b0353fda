"""Event analytics on Spark: ingest, silver and gold layers, metric reads."""

__version__ = "0.1.0"
