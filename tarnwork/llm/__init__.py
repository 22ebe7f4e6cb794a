"""Operators on language-model training text; nothing else of this package imports them."""
