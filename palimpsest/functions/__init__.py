"""Column functions: text, scores and hashes."""
