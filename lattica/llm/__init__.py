"""Training-data operators: tokenising, search, packing, dedup, quality, privacy, licences, toxicity."""
