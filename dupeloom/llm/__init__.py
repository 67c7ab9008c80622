"""Operators for building training corpora: dedup, scans, packing, search and language models.

Nothing else in the library imports this subpackage.
"""
