"""Training-data operators: extraction, language, mixing, duplicates, search, archives, tokens, toxicity."""
