"""Operators over document and embedding tables for preparing language-model training data.

Nothing else in the library imports this package.
"""
