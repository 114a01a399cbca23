"""Operators for preparing training text: tokens, pages, quality, duplicates, leaks.

Nothing outside this package imports it; removing it leaves the rest working.
"""
