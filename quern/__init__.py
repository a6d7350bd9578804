"""Retrieval over code and text, and data preparation, as DataFrame plans."""
