"""Training-data operators: near-duplicates, text clean-up, mixing, encoding, media."""
