"""Operators for text corpora: filtering, near-duplicates, redaction, tokens and exact search.

Nothing else in the library imports this package. Each module holds one operator with its own
interface; `queries` registers one query per operator over the given tables.
"""
