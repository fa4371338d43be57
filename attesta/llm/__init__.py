"""Training-data operators: tokenising, scoring, searching, de-duplicating, packing and writing.

Nothing outside this package imports it.
"""
