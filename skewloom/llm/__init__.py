"""Operators that prepare training data for language models; see the README for each one's method."""
