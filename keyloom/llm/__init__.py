"""Training-data operators: search, extraction, deduplication, scoring, mixing and scanning."""
