"""Training-data operators: filtering, near duplicates, scoring, packing, sharding, tokenising."""
