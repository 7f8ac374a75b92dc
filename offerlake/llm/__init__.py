"""Operators for building language-model training corpora on Spark.

Nothing outside this package imports it; it may import from the rest of the library.
"""
