"""Data operators: validation, silver, gold, metric reads, cohort review."""
