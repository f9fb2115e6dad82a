"""Training-data operators: dedup, filtering, mixing, tokenising and scoring of text corpora.

Nothing else in the library imports this subpackage.
"""
