"""Operators for preparing training text: ten jobs over documents, pages and conversations."""
