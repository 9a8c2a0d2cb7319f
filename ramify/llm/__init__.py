"""Training-data operators: sharding, deduplication, decontamination, scoring, tokenisation."""
