"""Operators for preparing language-model training data, each one a Spark job.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin queries that apply each
operator to a whole table; the operators themselves take and return DataFrames.
"""
