"""Training-data operators: filtering, deduplication, mixing and packing of corpora."""
