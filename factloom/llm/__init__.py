"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it. Every operator takes a session and
DataFrames, reads only the columns that it names, and returns a DataFrame.
"""
