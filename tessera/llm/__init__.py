"""Training-data operators: formatting, packing, scoring, scanning and deduplication."""
