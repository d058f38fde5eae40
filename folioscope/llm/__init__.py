"""Operators for the preparation of language-model training text. Nothing outside this folder imports it."""
