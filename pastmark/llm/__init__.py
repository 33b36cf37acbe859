"""Training-data operators: scoring, scanning, deduplication, mixing, packing and search over text tables."""
