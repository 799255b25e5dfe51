"""Training-data operators: archives, deduplication, tokenisation, mixing, quality, language models."""
