"""Operators for preparing large text corpora, each a DataFrame-to-DataFrame function."""
