"""Operators for corpora and embedding collections; nothing outside imports them."""
