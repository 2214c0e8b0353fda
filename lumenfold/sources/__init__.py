"""Sources and sinks: driver tables, NDJSON lines, Parquet export."""
