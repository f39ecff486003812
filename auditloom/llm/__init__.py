"""Training-data operators: dedup, mixing, packing, sharding, filters, language, media."""
