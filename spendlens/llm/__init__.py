"""Training-data operators: quality rules, language id, deduplication, packing, mixing, archives."""
