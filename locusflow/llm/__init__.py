"""Corpus-preparation operators: personal data, search, archives, quality,
near-duplicates, mixing, secrets, packing and toxicity."""
