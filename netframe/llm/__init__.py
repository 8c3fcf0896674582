"""Corpus operators for large text collections (one module per operator).

Nothing else in the library imports this subpackage.
"""
