"""Operators over raw text, pages and vectors for preparing training data.

Each module keeps one operator with a general interface; `queries` holds the thin registered queries.
Nothing outside this package imports it.
"""
