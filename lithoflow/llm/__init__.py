"""Operators for text corpora, vectors and typed names used as training data."""
