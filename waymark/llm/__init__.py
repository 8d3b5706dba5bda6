"""Training-data operators: quality, deduplication, search, mixing and packing."""
