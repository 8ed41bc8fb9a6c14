"""Operators that clean, deduplicate, score and mix text corpora, and search their vectors."""
