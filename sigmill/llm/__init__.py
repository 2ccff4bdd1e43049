"""Operators for large text corpora: cleaning, matching, scoring, tokenising and packing documents.

Nothing outside this subpackage imports it.
"""
