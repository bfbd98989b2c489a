"""Training-data operators: quality, dedup, privacy, language, mixing, packing, sharding, search and chat formatting."""
