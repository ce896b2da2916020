"""Operators that prepare language-model training text. Nothing outside this package imports it."""
