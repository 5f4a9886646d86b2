"""Training-data operators: quality, tokens, privacy, duplicates, search, packing, media."""
