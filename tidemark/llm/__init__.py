"""Training-data operators: deduplication, packing, tokenization, media, search and scoring."""
