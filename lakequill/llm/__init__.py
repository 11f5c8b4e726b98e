"""Operators for building training data: dedup, quality, search, tokenisation and packing.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
