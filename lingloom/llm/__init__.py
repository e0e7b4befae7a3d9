"""Operators that prepare training text: filters, deduplication, scoring, counting and mixing.

Nothing else in the library imports this subpackage.
"""
