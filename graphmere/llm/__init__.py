"""Operators for text that trains or feeds language models. Nothing else in the library imports this package."""
