"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Each operator is a function from
DataFrames to a DataFrame; ``registry`` holds the thin queries over them.
"""
