"""Training-data operators: filters, deduplication, scoring, formatting and mixing of text corpora."""
