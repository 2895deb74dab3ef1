"""Training-data operators: scoring, cleaning, de-duplication and mixing of text corpora.

Nothing else in the library imports this subpackage.
"""
