"""Training-data operators: deduplication, formatting, fingerprints, filters and mixing."""
