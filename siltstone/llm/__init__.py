"""Operators for text and record corpora that feed model training."""
