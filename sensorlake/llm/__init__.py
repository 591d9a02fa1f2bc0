"""Training-data operators: filtering, deduplication, packing and formatting of text corpora."""
