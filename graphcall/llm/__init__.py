"""Training-data operators: tokens, deduplication, cleaning, packing, chat and shards."""
