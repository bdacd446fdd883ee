"""Operators for text corpora and very large collections; nothing else in the library imports this."""
