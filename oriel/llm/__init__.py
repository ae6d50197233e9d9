"""Operators for preparing large text corpora: filters, deduplication, mixing and tokenisation.

Nothing else in the library imports this subpackage.
"""
