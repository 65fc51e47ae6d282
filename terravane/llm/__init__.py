"""Operators for preparing training text: deduplication, classification, mixing, scanning and extraction.

Nothing else in the library imports this subpackage.
"""
