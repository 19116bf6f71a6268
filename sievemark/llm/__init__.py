"""Training-data operators: quality, language, fingerprints, duplicates, tokens, personal data and secrets."""
