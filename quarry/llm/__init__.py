"""Training-data operators: scoring, mixing, fingerprints, near duplicates, archives, scans, tokenisation."""
