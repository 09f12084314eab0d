"""Training-data operators: detection, near-duplicates, tokens, packing, extraction."""
