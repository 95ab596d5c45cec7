"""Operators for preparing training text. Nothing else in the library imports this package.

Every operator takes DataFrames and returns a DataFrame. ``registry`` holds the
thin ``opN_*`` queries over the standard tables and their SQL.
"""
