"""Operators for preparing text corpora, images of pages and vectors for training.

Nothing else in the library imports this package.
"""
