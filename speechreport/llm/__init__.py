"""Operators for large training corpora: ten jobs over documents, pages and conversations."""
