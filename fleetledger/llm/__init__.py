"""Training-data operators: cleaning, formatting, scoring, deduplication, packing and extraction."""
