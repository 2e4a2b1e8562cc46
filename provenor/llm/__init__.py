"""Operators for preparing language-model training data at corpus scale.

Every operator is a function from DataFrames to DataFrames. Nothing outside
this subpackage imports it.
"""
