"""Column expressions: ids, hashes, codes, text."""
