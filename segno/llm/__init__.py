"""Training-data operators: deduplication, filtering, scanning, scoring, tokenising, search."""
