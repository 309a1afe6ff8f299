"""Operators on DataFrames: tables as documents, row schemas, rows and items of documents, sessions."""
