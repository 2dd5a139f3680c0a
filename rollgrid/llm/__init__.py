"""Operators for large training-data pipelines.

Every operator takes and returns DataFrames, reads only the columns it names
(extra columns never clash with its own), and states its result for nulls,
empty and very long texts, ties, repeated rows and empty tables in its
docstring. Nothing outside this subpackage imports it.
"""
