"""Operators for preparing language-model training text, on Spark DataFrames.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
